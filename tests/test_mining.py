import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN_TEMPLATES, texts
from loomline.functions import tokens as T
from loomline.operators import merging as G
from loomline.operators.evaluate import grouping_accuracy
from loomline.operators.leaders import Rounds
from loomline.options import DEFAULT_MASKS, MinerOptions
from loomline.plans.mining import assign_lines, assign_to_leaders, mine_templates
from loomline.session import stage

FAST = MinerOptions()


def test_golden(spark, golden):
    assert texts(mine_templates(golden, FAST).templates) == GOLDEN_TEMPLATES


def test_golden_other_profile(spark, golden):
    options = MinerOptions(depth=10, max_children=1000, numeric_tokens=False,
                           extra_delimiters=("_",))
    # Five leading tokens keep the pumps apart at first; by their ends "three" meets "three".
    deep = {t for t in GOLDEN_TEMPLATES if "operator" not in t[0]} | {
        ("<*> <*> started by operator <*>", 4), ("valve nine closed by operator carla", 1)}
    assert texts(mine_templates(golden, options).templates) == deep


@pytest.mark.parametrize("depth", [10, 400])
def test_deep_keys_are_planned(spark, golden, depth):
    options = MinerOptions(depth=depth, max_children=3)
    assert mine_templates(golden, options).templates.agg(F.sum("size")).first()[0] == 15


def test_order_and_partitions_do_not_matter(spark, golden):
    shuffled = golden.orderBy(F.rand(5)).repartition(7)
    a = mine_templates(golden, FAST).templates
    b = mine_templates(shuffled, FAST).templates
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def leader_algorithm(members, th):
    """Plain restatement of one pass: {node: leader}."""
    ranked = sorted(members, key=lambda m: (-m["known"], -m["cnt"], m["first_id"], m["node_id"]))

    def sim(leader, m):
        n = len(m["tokens"])
        same = sum(a == b != "<*>" for a, b in zip(leader["tokens"], m["tokens"]))
        return same / n if n else 1.0

    leaders = []
    for m in ranked:
        if not any(sim(k, m) >= th for k in leaders):
            leaders.append(m)
    out = {}
    for m in ranked:
        best = max(range(len(leaders)), key=lambda i: (
            2.0 if leaders[i] is m else sim(leaders[i], m), leaders[i]["tokens"].count("<*>"), -i))
        out[m["node_id"]] = leaders[best]["node_id"]
    return out


def random_nodes(count, seed=1):
    rng = random.Random(seed)
    rows = {}
    for i in range(count):
        n = rng.choice([0, 1, 3, 5])
        tokens = tuple(rng.choice(["a", "b", "c", "d", "e", "<*>"]) for _ in range(n))
        rows[tokens] = (f"b{n}", f"id{i:04d}", rng.randint(0, 1), n, list(tokens),
                        rng.randint(1, 4), i, i, 1)
    return list(rows.values())


NODES = ("block string, node_id string, known int, n int, tokens array<string>, cnt long, "
         "first_id long, last_id long, shapes long")


@pytest.mark.parametrize("leaders", [1, 4, 64])
def test_one_pass_matches_restatement(spark, leaders):
    """The rounds are an evaluation detail: any number of leaders per round
    gives the result of the plain algorithm."""
    nodes = random_nodes(80)
    options = FAST.with_(sim_th=0.7, round_leaders=leaders)
    got = {r["node_id"]: r["leader_id"] for r in assign_to_leaders(
        spark.createDataFrame(nodes, NODES), options).collect()}
    blocks = defaultdict(list)
    for row in nodes:
        blocks[row[0]].append(dict(zip(
            ("block", "node_id", "known", "n", "tokens", "cnt", "first_id"), row)))
    want = {}
    for members in blocks.values():
        want |= leader_algorithm(members, 0.7)
    assert got == want


@pytest.mark.parametrize("leaders", [5, 256])
def test_a_large_block_stays_whole(spark, leaders):
    """More than a thousand leaders in one block, in several rounds."""
    rng = random.Random(8)
    rows = {tuple(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(1700)}
    nodes = [("b6", f"id{i:05d}", 0, 6, list(t), 1 + i % 3, i, i, 1)
             for i, t in enumerate(sorted(rows))]
    members = [dict(zip(("block", "node_id", "known", "n", "tokens", "cnt", "first_id"), row))
               for row in nodes]
    want = leader_algorithm(members, 0.6)
    assert len(set(want.values())) > 1000
    got = {r["node_id"]: r["leader_id"] for r in assign_to_leaders(
        spark.createDataFrame(nodes, NODES), FAST.with_(sim_th=0.6, round_leaders=leaders)).collect()}
    assert got == want


def test_rounds_do_not_grow_with_leaders(spark):
    """20,000 leaders and more in one block: candidates by index, few parallel steps."""
    rng = np.random.default_rng(4)
    drawn = np.unique(rng.integers(0, 40, size=(21_500, 6)), axis=0)
    drawn = drawn[rng.permutation(len(drawn))]
    leads = np.zeros(len(drawn), dtype=bool)
    for i, member in enumerate(drawn):
        leads[i] = not ((drawn[:i] == member).sum(axis=1) >= 4)[leads[:i]].any()
    assert leads.sum() > 20_000
    nodes = [("b6", f"id{i:05d}", 0, 6, [f"t{v}" for v in member], 1, i, i, 1)
             for i, member in enumerate(drawn.tolist())]
    rounds = Rounds()
    got = {r["node_id"]: r["leader_id"] for r in assign_to_leaders(
        spark.createDataFrame(nodes, NODES), FAST.with_(sim_th=0.6), rounds).collect()}
    assert rounds.fronts + rounds.steps < 20
    assert {n for n, leader in got.items() if n == leader} == {f"id{i:05d}" for i in np.nonzero(leads)[0]}
    kept = np.nonzero(leads)[0]
    for i in np.nonzero(~leads)[0]:
        same = (drawn[kept] == drawn[i]).sum(axis=1)
        assert got[f"id{i:05d}"] == f"id{kept[same.argmax()]:05d}"


def test_a_chain_of_better_neighbours(spark):
    """Each member is similar to the next one only, so every second one leads."""
    nodes = [("b", f"id{i:03d}", 0, 4, [f"a{i // 2}", f"b{(i + 1) // 2}", f"a{i // 2}", f"b{(i + 1) // 2}"], 1, i, i, 1)
             for i in range(60)]
    rounds = Rounds()
    got = {r["node_id"]: r["leader_id"] for r in assign_to_leaders(
        spark.createDataFrame(nodes, NODES), FAST.with_(sim_th=0.5, round_leaders=2), rounds).collect()}
    members = [dict(zip(("block", "node_id", "known", "n", "tokens", "cnt", "first_id"), row)) for row in nodes]
    assert got == leader_algorithm(members, 0.5)


LEXICON = [("red", True, "JJ"), ("blue", True, "JJ"), ("door", True, "NN"), ("gate", True, "NN"), ("opens", True, "VBZ"),
           ("shuts", True, "VBZ"), ("of", False, "IN"), ("the", False, "DT"), ("a", False, "DT"), ("Up", None, "RB"),
           ("to", False, "TO"), ("Go", True, "VB"), ("==", None, None)]
TOKENS = [w for w, *_ in LEXICON] + ["x1", "X9", "AB", "CD", ":", "=", ",", ".", "a_b", "c_d", "camelCase", "otherCase",
                                     "n::m", "p/q", "<NUM>", "<*>", "zebra", "Über"]


def test_vetoes_by_facts_equal_the_vetoes_by_tokens(spark):
    from loomline.functions import facts as R
    from loomline.functions import similarity as S

    rng = random.Random(11)
    rows = []
    for i in range(1500):
        n = rng.randint(0, 6)
        a = [rng.choice(TOKENS) for _ in range(n)]
        b = [t if rng.random() < 0.6 else rng.choice(TOKENS) for t in a]
        rows += [(f"{i}a", a), (f"{i}b", b)]
    lexicon = spark.createDataFrame(LEXICON, "token string, known boolean, tag string")
    nodes = R.with_facts(spark.createDataFrame(rows, "node_id string, tokens array<string>"), lexicon, FAST)
    words = {w: (bool(k), t or "") for w, k, t in LEXICON}
    known = F.transform("tokens", lambda t: t.isin(*[w for w, (k, _) in words.items() if k]))
    tag_of = F.create_map(*[F.lit(v) for w, (_, tag) in words.items() for v in (w, tag)])
    tags = F.transform("tokens", lambda t: F.coalesce(F.try_element_at(tag_of, t), F.lit("")))
    side = nodes.select(F.substring_index("node_id", "a", 1).alias("i"), "*", known.alias("known"), tags.alias("tags"))
    a = side.filter(F.col("node_id").endswith("a")).select("i", F.struct("tokens", "facts", "known", "tags").alias("a"))
    b = side.filter(F.col("node_id").endswith("b")).select(
        F.substring_index("i", "b", 1).alias("i"), F.struct("tokens", "facts", "known", "tags").alias("b"))
    pairs = a.join(b, "i").select("a.*", F.col("b.tokens").alias("x"), F.col("b.facts").alias("xf"),
                                  F.col("b.known").alias("xk"), F.col("b.tags").alias("xt"))
    c = F.col
    by_tokens = {
        "static": S.static_position_veto(c("tokens"), c("x")),
        "dictionary": S.dictionary_veto(c("tokens"), c("x"), c("known"), c("xk"), c("tags")),
        "pos": S.pos_veto(c("tokens"), c("x"), c("tags"), c("xt"))}
    checked = pairs.select("tokens", "x", *[
        F.struct(R.veto_by_facts(c("tokens"), c("x"), c("facts"), c("xf"), *[k == name for k in by_tokens]).alias("got"),
                 rule.alias("want")).alias(name) for name, rule in by_tokens.items()]).collect()
    assert len(checked) == 1500
    for name in by_tokens:
        assert all(r[name]["got"] == r[name]["want"] for r in checked), name
        assert 10 < sum(r[name]["want"] for r in checked) < 1490


def test_words_keep_templates_apart(spark):
    rows = [(1, "the red door opens 7"), (2, "the red gate opens 7"), (3, "the red door opens 8")]
    lines = spark.createDataFrame(rows, "line_id long, text string")
    lexicon = spark.createDataFrame(LEXICON, "token string, known boolean, tag string")
    loose = texts(mine_templates(lines, FAST).templates)
    strict = texts(mine_templates(lines, FAST.with_(dictionary_veto=True), lexicon=lexicon).templates)
    assert loose == {("the red <*> opens <*>", 3)}
    assert strict == {("the red door opens <*>", 2), ("the red gate opens 7", 1)}
    with pytest.raises(ValueError):
        mine_templates(lines, FAST.with_(pos_veto=True))


def labelled(spark, count=4000):
    """Lines from hand-written templates, one of them holding a third."""
    node = F.concat(F.lit("node"), F.abs(F.xxhash64("id", F.lit(1))) % 500)
    num = (F.abs(F.xxhash64("id", F.lit(2))) % 100000).cast("string")
    ip = F.concat_ws(".", *[(F.abs(F.xxhash64("id", F.lit(k))) % 255).cast("string")
                            for k in range(3, 7)])
    shapes = [
        [F.lit("connection from"), ip, F.lit("closed after"), num, F.lit("ms")],
        [F.lit("disk"), node, F.lit("is full")],
        [F.lit("started worker"), node, F.lit("with"), num, F.lit("threads")],
        [F.lit("heartbeat")],
        [F.lit("cannot open"), F.concat(F.lit("/data/"), node), F.lit("permission denied")],
        [F.lit("user"), node, F.lit("logged in from"), ip],
        [F.lit("user"), node, F.lit("logged out")],
        [F.lit("retry"), num, F.lit("of request"), num, F.lit("failed with code"), num],
    ]
    pick = F.when(F.col("id") % 3 == 0, 0).otherwise(F.abs(F.xxhash64("id")) % len(shapes))
    text = F.coalesce(*[F.when(F.col("pick") == i, F.concat_ws(" ", *s))
                        for i, s in enumerate(shapes)])
    return spark.range(count).withColumn("pick", pick).select(
        F.col("id").alias("line_id"), text.alias("text"),
        F.concat(F.lit("E"), "pick").alias("event_id")).cache()


def test_labelled_lines_and_properties(spark):
    lines = labelled(spark)
    options = FAST.with_(masks=DEFAULT_MASKS)
    mined = mine_templates(lines, options)
    assigned = assign_lines(lines, mined, options).cache()
    assert assigned.count() == lines.count() == assigned.select("line_id").distinct().count()
    score = grouping_accuracy(
        assigned.select("line_id", F.col("template_id").alias("cluster_id")),
        lines.select("line_id", "event_id")).first()
    assert (score["lines"], score["accuracy"]) == (4000, 1.0)
    assert mined.templates.agg(F.sum("size")).first()[0] == 4000
    # Each literal position equals the line's token.
    checked = (mined.lineage.join(mined.shapes, "shape_id")
               .join(mined.templates.select("template_id", F.col("tokens").alias("t")), "template_id"))
    fits = F.forall(F.zip_with("t", "tokens", lambda t, x: (t == "<*>") | (t == x)), lambda b: b)
    assert checked.filter(~fits | (F.size("t") != F.size("tokens"))).count() == 0
    assert checked.count() == mined.shapes.count()


def test_static_veto_keeps_named_values_apart(spark):
    rows = [(1, "state READY of unit 1"), (2, "state DOWN of unit 2"), (3, "state READY of unit 3")]
    lines = spark.createDataFrame(rows, "line_id long, text string")
    options = FAST.with_(masks=DEFAULT_MASKS)
    loose = texts(mine_templates(lines, options).templates)
    strict = texts(mine_templates(lines, options.with_(static_veto=True)).templates)
    assert loose == {("state <*> of unit <NUM>", 3)}
    assert strict == {("state READY of unit <NUM>", 2), ("state DOWN of unit <NUM>", 1)}


def test_keys_do_not_mix(spark):
    lines = spark.createDataFrame(
        [("x", 1, "a b c"), ("x", 2, "a b d"), ("y", 3, "a b c"), ("y", 4, "")],
        "dataset string, line_id long, text string")
    mined = mine_templates(lines, FAST, ["dataset"])
    rows = {(r["dataset"], " ".join(r["tokens"]), r["size"]) for r in mined.templates.collect()}
    assert rows == {("x", "a b <*>", 2), ("y", "a b c", 1), ("y", "", 1)}


def test_fuse_matches_union_find(spark):
    rng = random.Random(2)
    links = [(f"s{rng.randint(0, 80)}", f"t{rng.randint(0, 60):02d}") for _ in range(110)]
    links += [(f"chain{i}", f"c{j:03d}") for i in range(40) for j in (i, i + 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for s, t in links:
        parent[find(s)] = find(t)
    groups = defaultdict(set)
    for _, t in links:
        groups[find(t)].add(t)
    want = {t: min(g) for g in groups.values() for t in g}
    df = spark.createDataFrame(links, "shape_id string, template_id string")
    assert {r["template_id"]: r["fused_id"] for r in G.fuse_labels(df).collect()} == want


def test_fused_tokens_and_sizes(spark):
    links = spark.createDataFrame([("s1", "t1", 2), ("s1", "t2", 3), ("s2", "t3", 1)],
                                  "shape_id string, template_id string, cnt long")
    templates = spark.createDataFrame([("t1", ["a", "<*>", "c"]), ("t2", ["a", "b", "<*>"]),
                                       ("t3", ["x"])], "template_id string, tokens array<string>")
    rows = {(r["fused_id"], " ".join(r["tokens"]), r["size"], r["members"])
            for r in G.fuse_templates(links, templates).collect()}
    assert rows == {("t1", "a <*> <*>", 5, 2), ("t3", "x", 1, 1)}


def test_change_log_and_retention(spark):
    kind = "template_id string, tokens array<string>, size long, last_id long"
    old = spark.createDataFrame([("a", ["x"], 1, 1), ("b", ["y", "z"], 1, 2), ("c", ["q"], 1, 3)], kind)
    new = spark.createDataFrame([("a", ["x"], 5, 9), ("b", ["y", "<*>"], 2, 8), ("d", ["n"], 1, 7)], kind)
    changes = {r["template_id"]: r["change_type"] for r in G.change_log(old, new).collect()}
    assert changes == {"a": "none", "b": "changed", "c": "removed", "d": "created"}
    assert {r["template_id"] for r in G.retain_templates(new, 2).collect()} == {"a", "b"}
    assert G.retain_templates(new, None).count() == 3


def test_cap_children(spark):
    from loomline.operators import blocks as B
    words = ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["d"]
    shapes = spark.createDataFrame([(f"s{i}", 3, [w, str(i), "z"], 1) for i, w in enumerate(words)],
                                   "shape_id string, n int, tokens array<string>, cnt long")
    options = MinerOptions(max_children=3)
    capped = B.cap_children(B.with_prefix_key(shapes, options, "key"), "key", 1, options)
    got = defaultdict(int)
    for r in capped.collect():
        got[r["key"][0]] += 1
    assert got == {"a": 5, "b": 3, "<*>": 3}


def test_empty_group_tokens(spark):
    df = spark.createDataFrame([("g", ["a", "b"]), ("g", ["a", "c"]), ("h", ["x"]), ("e", []), ("e", [])],
                               "g string, tokens array<string>")
    rows = {r["g"]: r["tokens"] for r in G.merge_group(df, ["g"]).collect()}
    assert rows == {"g": ["a", "<*>"], "h": ["x"], "e": []}
    assert T.SEP == "\x01"


def test_null_blank_and_control_lines_keep_their_rows(spark):
    """Lines whose tokens were once written alike stay one row each."""
    lines = spark.createDataFrame([(1, None), (2, ""), (3, "a\x01b"), (4, "a b"), (5, "  ")],
                                  "line_id long, text string")
    mined = mine_templates(lines, FAST)
    tagged = assign_lines(lines, mined, FAST)
    rows = {r["line_id"]: r for r in G.line_results(tagged, mined.templates).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and tagged.count() == 5
    assert len({rows[i]["cluster_id"] for i in (1, 2, 5)}) == 1
    assert len({r["cluster_id"] for r in rows.values()}) == 3


def test_fusing_rounds_hold_numbers_only(spark, monkeypatch):
    """A long chain takes many rounds, and none of them moves ids as text."""
    from loomline.operators import components
    written = []

    def kept(df, label="stage"):
        written.append([t for _, t in df.dtypes])
        return stage(df, label)

    monkeypatch.setattr(components, "stage", kept)
    monkeypatch.setattr(G, "stage", kept)
    names = [f"t{i:03d}" for i in range(60)]
    random.Random(5).shuffle(names)
    links = [(f"s{i}", t) for i, pair in enumerate(zip(names, names[1:])) for t in pair]
    links += [("hub", t) for t in ("u1", "u2", "u3", "u1")] + [("one", "v"), (None, "w"), ("x", None)]
    got = {r["template_id"]: r["fused_id"] for r in G.fuse_labels(
        spark.createDataFrame(links, "shape_id string, template_id string")).collect()}
    assert got == {**{t: "t000" for t in names}, "u1": "u1", "u2": "u1", "u3": "u1", "v": "v"}
    assert sum("string" in types for types in written) <= 4 and len(written) > 8
