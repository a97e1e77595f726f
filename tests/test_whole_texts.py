"""Folding and annotating without a row for each token."""

from pyspark.sql import functions as F

from loomline.functions import tokens as T
from loomline.operators.lines import annotate_tokens, distinct_shapes
from loomline.operators import matching
from loomline.operators.merging import merge_group
from loomline.operators.paths import reached_counts, reached_templates
from loomline.options import MinerOptions


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


ODD = [[], [""], ["", ""], ["a"], ["a\u0001b"], ["a", "b"], ["\u0002", "é\"\\"], ["\u0001"], ["x"] * 130]


def test_packed_tokens_come_back(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, tokens array<string>")
    back = rows.withColumn("p", T.pack_tokens(F.col("tokens"))).repartition("p").select(
        "id", T.unpack_tokens(F.col("p")).alias("tokens")).orderBy("id").collect()
    assert [r.tokens for r in back] == ODD


def test_shapes_are_shuffled_as_one_text(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ODD)], "line_id long, tokens array<string>")
    shapes = distinct_shapes(lines)
    assert sorted((r.tokens, r.cnt, r.first_id, r.last_id) for r in shapes.collect()) == sorted(
        (t, 2, i, i + len(ODD)) for i, t in enumerate(ODD))
    assert "Aggregate [tokens" not in plan_of(shapes)


def test_groups_fold_without_a_row_for_each_token(spark):
    long = [f"w{i}" for i in range(150)]
    other = [t if i % 7 else "else" for i, t in enumerate(long)]
    rows = [("one", ["a", "b"]), ("two", ["a", "b"]), ("two", ["a", "c"]), ("same", ["a"]), ("same", ["a"]),
            (None, ["x", "y"]), (None, ["z", "y"]), ("empty", []), ("empty", []), ("gone", None),
            ("long", long), ("long", other), ("mixed", ["a", "b", "c"]), ("mixed", ["a", "d"])]
    members = spark.createDataFrame(rows, "g string, tokens array<string>")
    folded = merge_group(members, ["g"])
    got = {r.g: r.tokens for r in folded.collect()}
    assert got == {"one": ["a", "b"], "two": ["a", "<*>"], "same": ["a"], None: ["<*>", "y"], "empty": [], "gone": [],
                   "long": [t if i % 7 else "<*>" for i, t in enumerate(long)], "mixed": ["a", "<*>", "c"]}
    assert "posexplode" not in plan_of(folded)


def test_tokens_are_looked_up_once_a_piece(spark):
    rows = [("s1", ["a", "b", "a"]), ("s2", []), ("s3", None), ("s4", ["zz"])]
    shapes = spark.createDataFrame(rows, "shape_id string, tokens array<string>")
    lexicon = spark.createDataFrame([("a", "NN", True), ("b", "VB", False)], "token string, tag string, known boolean")
    named = annotate_tokens(shapes, lexicon, ["tag", "known"])
    assert "posexplode" not in plan_of(named)
    assert {r.shape_id: (r.tokens, r.tag, r.known) for r in named.collect()} == {
        "s1": (["a", "b", "a"], ["NN", "VB", "NN"], [True, False, True]), "s2": ([], [], []),
        "s3": (None, [], []), "s4": (["zz"], [None], [None])}


def test_reached_templates_are_counted_without_pairs(spark, monkeypatch):
    shapes = spark.createDataFrame([(f"s{i}", 2, [h, "x"]) for i, h in enumerate(["a", "b", "c", "a"])] + [
        ("empty", 0, []), ("lost", 3, ["a", "b", "c"])], "shape_id string, n int, tokens array<string>")
    old = [("t1", 2, ["<*>"]), ("t2", 2, ["<*>"]), ("t2", 2, ["a"]), ("t3", 2, ["a"]), ("t3", 2, ["b"]), ("t4", 0, [])]
    new = [("t1", 2, ["a"]), ("t2", 2, ["<*>"]), ("t2", 2, ["b"]), ("t3", 2, ["b"]), ("t4", 0, [])]
    history, current = (spark.createDataFrame(k, "template_id string, n int, key array<string>").withColumn(
        "batch", F.lit(0)) for k in (old, new))
    made = []

    def watched(*given):
        made.append(reached_templates(*given))
        return made[-1]

    monkeypatch.setattr("loomline.operators.paths.reached_templates", watched)
    got = {r.shape_id: (r.reached, r.by_old_keys) for r in reached_counts(shapes, history, current, MinerOptions()).collect()}
    assert got == {"s0": (3, 1), "s3": (3, 1), "s1": (3, 1), "s2": (2, 1), "empty": (1, 0)}
    # Heads by keys: 5 heads reach 3 old and 3 new keys at most, whatever the number of templates.
    assert all(m.count() <= 7 for m in made)


def test_templates_without_wildcards_match_by_content(spark, monkeypatch):
    shapes = spark.createDataFrame([("s1", 2, ["a", "b"]), ("s2", 2, ["a", "c"]), ("s3", 0, [])],
                                   "shape_id string, n int, tokens array<string>")
    catalog = spark.createDataFrame([("t1", 2, ["a", "b"]), ("t2", 2, ["a", "b"]), ("t3", 2, ["a", "<*>"]), ("t4", 0, []),
                                     ("t5", 2, ["<*>", "<*>"])], "template_id string, n int, tokens array<string>")
    anchored = []
    anchor_templates = matching.anchor_templates
    monkeypatch.setattr(matching, "anchor_templates", lambda *given: anchored.append(given[0]) or anchor_templates(*given))
    got = {(r.shape_id, r.template_id, r.params) for r in matching.match_pairs(shapes, catalog).collect()}
    assert got == {("s1", "t1", 0), ("s1", "t2", 0), ("s1", "t3", 1), ("s2", "t3", 1), ("s1", "t5", 2), ("s2", "t5", 2),
                   ("s3", "t4", 0)}
    assert {r.template_id for r in anchored[0].collect()} == {"t3", "t4", "t5"}
