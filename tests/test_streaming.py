import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN_TEMPLATES, texts
from loomline.options import DEFAULT_MASKS, MinerOptions
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.plans.mining import mine_templates
from loomline.queries.streams import as_stream
from loomline.session import fresh_dir
from loomline.streaming.catalog import CatalogStore
from loomline.streaming.match import stream_match
from loomline.streaming.mine import stream_mine, update_catalog

@pytest.mark.parametrize("files", [1, 3])
def test_catalog_covers_all_lines(spark, golden, files):
    lines = golden.select("line_id", "text")
    store = CatalogStore(spark, fresh_dir(spark, "catalog")).create()
    stream_mine(as_stream(lines, files), store, MinerOptions(),
                fresh_dir(spark, "progress")).awaitTermination()
    assert len(store.versions()) == files + 1
    catalog = store.restore()
    assert catalog.agg(F.sum("size")).first()[0] == 15
    if files == 1:
        assert texts(catalog) == GOLDEN_TEMPLATES


def test_restart_continues_and_replay_is_idempotent(spark):
    options = MinerOptions(masks=DEFAULT_MASKS, sim_th=0.9)
    feed, progress = fresh_dir(spark, "feed"), fresh_dir(spark, "progress")
    store = CatalogStore(spark, fresh_dir(spark, "catalog")).create()
    schema = "line_id long, text string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        stream_mine(stream, store, options, progress).awaitTermination()

    run([(1, "a 1 b"), (2, "x y z")])
    run([(3, "a 7 b"), (4, "new line here")])
    assert texts(store.restore()) == {("a <NUM> b", 2), ("x y z", 1), ("new line here", 1)}
    assert texts(store.restore(0)) == {("a <NUM> b", 1), ("x y z", 1)}
    # The second batch once more gives the same version.
    again = spark.createDataFrame([(3, "a 7 b"), (4, "new line here")], schema)
    shapes = distinct_shapes(with_tokens(again, options))
    before = sorted(map(str, store.restore(1).collect()))
    store.save(update_catalog(store.before(1), shapes, options), 1)
    assert sorted(map(str, store.restore(1).collect())) == before
    reasons = {r["change_type"]: r["reason"] for r in store.restore(1).collect()}
    assert reasons["none"] is None and reasons["created"].startswith("created (")
    store.snapshot(1)
    assert [c["label"] for c in store.commits() if c["kind"] == "snapshot"] == [None, "periodic"]
    assert sorted(map(str, store.restore(1).collect())) == before


TEMPLATES = "template_id string, n int, tokens array<string>, size long, shapes long, first_id long, last_id long"


def catalog_of(spark, rows):
    """{id: (text, size)} as a catalog."""
    return spark.createDataFrame([(i, len(t.split()), t.split(), s, 1, 1, s) for i, (t, s) in rows.items()], TEMPLATES)


def shown(df):
    return {r["template_id"]: (" ".join(r["tokens"]), r["size"]) for r in df.collect()}


STATES = [{"a": ("x y", 1)}, {"a": ("x y", 2), "b": ("p q", 1)}, {"a": ("x <*>", 5)}, {"a": ("x <*>", 5), "c": ("z", 1)},
          {"b": ("p q", 9)}, {"b": ("p q", 9), "c": ("z z", 1)}]


@pytest.mark.parametrize("every", [1, 3, 100])
def test_every_version_is_restored(spark, every):
    store = CatalogStore(spark, fresh_dir(spark, "catalog"), snapshot_every=every).create()
    for version, state in enumerate(STATES):
        store.save(catalog_of(spark, state), version)
    assert [shown(store.restore(v)) for v in range(len(STATES))] == STATES
    changes = {(r["version"], r["template_id"]): r["change_type"] for r in store.history().collect()}
    assert changes == {(0, "a"): "created", (1, "a"): "none", (1, "b"): "created", (2, "a"): "changed", (2, "b"): "removed",
                       (3, "c"): "created", (4, "a"): "removed", (4, "b"): "created", (4, "c"): "removed", (5, "c"): "created"}
    longest = max(c["deltas"] for c in store.commits())
    assert longest <= every


def test_a_crash_between_files_leaves_the_older_version(spark, monkeypatch):
    store = CatalogStore(spark, fresh_dir(spark, "catalog")).create()
    store.save(catalog_of(spark, STATES[0]), 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(CatalogStore, "_commit", crash)
        with pytest.raises(OSError):
            store.save(catalog_of(spark, STATES[1]), 1)
    again = CatalogStore(spark, store.path).create()
    assert again.versions() == [-1, 0] and shown(again.restore()) == STATES[0]
    again.save(catalog_of(spark, STATES[2]), 1)
    assert shown(again.restore()) == STATES[2]


def test_snapshots_by_time(spark):
    store = CatalogStore(spark, fresh_dir(spark, "catalog"), snapshot_seconds=0.0).create()
    store.save(catalog_of(spark, STATES[0]), 0)
    assert [c["kind"] for c in store.commits()] == ["snapshot", "delta", "snapshot"]


def test_former_ids_lead_to_the_end(spark):
    store = CatalogStore(spark, fresh_dir(spark, "catalog"), snapshot_every=2).create()
    ids = "template_id string, to_id string"
    steps = [([], ["a", "b", "c", "d", "e"]), ([("a", "b")], ["b", "c", "d", "e"]), ([("b", "c"), ("e", "d")], ["c", "d"]),
             ([("c", "d")], ["d"]), ([], ["d", "e"])]
    for version, (merged, alive) in enumerate(steps):
        store.save(catalog_of(spark, {i: (f"{i} t", 1) for i in alive}), version, merged=spark.createDataFrame(merged, ids))
    asked = spark.createDataFrame([(i,) for i in "abcdez"], "template_id string").withColumn("asked", F.col("template_id"))
    ends = {r["asked"]: r["template_id"] for r in store.resolve(asked).collect()}
    assert ends == {"a": "d", "b": "d", "c": "d", "d": "d", "e": "e", "z": "z"}  # e came back
    before = {r["asked"]: r["template_id"] for r in store.resolve(asked, 2).collect()}
    assert before == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "d", "z": "z"}


BATCHES = [
    [(1, "pump one started"), (2, "pump one started"), (3, "valve a shut")],
    [(4, "pump two started"), (5, "new kind of line"), (6, "valve a shut"), (7, "pump one started")],
    [(8, "pump six failed"), (9, "valve a shut"), (10, ""), (11, None)],
    [(12, "quite another line of words"), (13, "pump two started")]]


def test_results_of_each_line_and_lineage(spark):
    store, out = CatalogStore(spark, fresh_dir(spark, "catalog")).create(), fresh_dir(spark, "results")
    feed, progress = fresh_dir(spark, "feed"), fresh_dir(spark, "progress")
    schema = "line_id long, text string"
    for batch in BATCHES:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        stream_mine(spark.readStream.schema(schema).parquet(feed), store, MinerOptions(), progress,
                    results=out).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["line_id"] for r in rows) == list(range(1, 14))
    kind = {r["line_id"]: r["change_type"] for r in rows}
    assert kind[1] == kind[2] == kind[5] == "created" and kind[6] == "none" and kind[4] == "changed"
    final = shown(store.restore())
    told = store.resolve(spark.read.parquet(out).withColumnRenamed("cluster_id", "template_id")).collect()
    texts_of = {line: (t or "").split() for batch in BATCHES for line, t in batch}
    counts = {}
    for r in told:
        template = final[r["template_id"]][0].split()
        assert len(template) == len(texts_of[r["line_id"]])
        assert all(a in ("<*>", b) for a, b in zip(template, texts_of[r["line_id"]]))
        counts[r["template_id"]] = counts.get(r["template_id"], 0) + 1
    assert counts == {i: size for i, (_, size) in final.items()}


def test_retention_by_batch(spark):
    """At most ``max_clusters`` templates after each batch, those used last."""
    options = MinerOptions(max_clusters=3, sim_th=0.9)
    batches = [["a b", "c d e", "f g h i", "a b"], ["j", "c d e"], ["k l m n o", "p q r s t u", "a b"], ["j", "v w"]]
    catalog, line, plain = spark.createDataFrame([], TEMPLATES), 0, {}
    for batch in batches:
        rows = []
        for text in batch:
            line += 1
            rows.append((line, text))
            size = plain.get(text, (0, 0))[0] + 1
            plain[text] = (size, line)
        plain = dict(sorted(plain.items(), key=lambda kv: -kv[1][1])[:3])
        shapes = distinct_shapes(with_tokens(spark.createDataFrame(rows, "line_id long, text string"), options))
        catalog = update_catalog(catalog, shapes, options)
        assert texts(catalog) == {(t, size) for t, (size, _) in plain.items()}


def test_stream_match_equals_batch(spark, golden):
    options = MinerOptions()
    lines = golden.select("line_id", "text")
    mined = mine_templates(lines, options)
    extra = lines.unionByName(spark.createDataFrame([(99, "never seen before this"), (98, "")],
                                                    "line_id long, text string"))
    path = fresh_dir(spark, "matched")
    stream_match(as_stream(extra, 2), mined.templates, options, path,
                 fresh_dir(spark, "progress")).awaitTermination()
    out = spark.read.parquet(path)
    names = {r["template_id"]: " ".join(r["tokens"]) for r in mined.templates.collect()}
    got = {r["line_id"]: names.get(r["template_id"]) for r in out.collect()}
    assert got[99] is None and got[98] is None
    assert got[1] == "pump <*> started by operator <*>" and got[14] == (
        "<*> <*> moved from rack <*> to rack <*>")
    assert len(got) == 17
