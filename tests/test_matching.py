import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import matching as M
from loomline.operators import params as P
from loomline.options import DEFAULT_MASKS, Mask, MinerOptions, TUNED_MASKS

SHAPES = "shape_id string, n int, tokens array<string>"
TEMPLATES = "template_id string, n int, tokens array<string>"


def data(seed=3):
    rng = random.Random(seed)
    words = ["a", "b", "c", "1", "22"]
    shapes = {tuple(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4])))
              for _ in range(150)}
    templates = {tuple(t if rng.random() < 0.5 else "<*>" for t in s)
                 for s in rng.sample(sorted(shapes), 50)}
    return ([(f"s{i:03d}", len(s), list(s)) for i, s in enumerate(sorted(shapes))],
            [(f"t{i:03d}", len(t), list(t)) for i, t in enumerate(sorted(templates))])


def leaf_walk(tokens, leaves, levels):
    path = ()
    for token in tokens[:max(min(levels + 1, len(tokens)) - 1, 0)]:
        nodes = {leaf[:len(path) + 1] for n, leaf in leaves if n == len(tokens)}
        for child in (token, "<*>"):
            if path + (child,) in nodes:
                path += (child,)
                break
        else:
            return None
    return path


def own_leaf(tokens, levels):
    head = tokens[:max(min(levels + 1, len(tokens)) - 1, 0)]
    return tuple("<*>" if any(c.isdigit() for c in t) else t for t in head)


@pytest.mark.parametrize("depth", [4, 5])
@pytest.mark.parametrize("prefer", ["most_wildcards", "fewest_wildcards"])
def test_strategies_match_restatement(spark, depth, prefer):
    shapes, templates = data()
    options = MinerOptions(depth=depth, prefer=prefer)
    sdf, tdf = spark.createDataFrame(shapes, SHAPES), spark.createDataFrame(templates, TEMPLATES)
    levels = depth - 3
    leaves = {(n, own_leaf(t, levels)) for _, n, t in templates}
    sign = -1 if prefer == "most_wildcards" else 1
    want = {"always": {}, "never": {}, "fallback": {}}
    for sid, n, tokens in shapes:
        leaf = leaf_walk(tokens, leaves, levels)
        fits = sorted((sign * t.count("<*>"), tid, own_leaf(t, levels)) for tid, m, t in templates
                      if m == n and all(a in ("<*>", b) for a, b in zip(t, tokens)))
        near = [f for f in fits if f[2] == leaf]
        if fits:
            want["always"][sid] = fits[0][1]
            want["fallback"][sid] = (near or fits)[0][1]
        if near:
            want["never"][sid] = near[0][1]
    for strategy, expected in want.items():
        got = {r["shape_id"]: r["template_id"]
               for r in M.match_lines(sdf, tdf, options, strategy).collect()}
        assert got == expected, strategy
    assert want["never"] != want["fallback"]


def test_unknown_strategy(spark):
    shapes, templates = data()
    with pytest.raises(ValueError):
        M.match_lines(spark.createDataFrame(shapes, SHAPES),
                      spark.createDataFrame(templates, TEMPLATES), MinerOptions(), "some")


def extract(spark, options, pairs, exact=True):
    rows = [(i, f"t{i}", line, t) for i, (t, line) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, template_id string, text string, template string")
    out = P.extract_parameters(df.drop("template"), df.select("template_id", "template"), options,
                               exact)
    return [None if r["parameters"] is None else [tuple(p) for p in r["parameters"]]
            for r in out.orderBy("i").collect()]


def test_extract_loose(spark):
    got = extract(spark, MinerOptions(), [
        ("user <*> left", "user  bob left"), ("user <*> left", "bye"), ("plain", "plain"),
        ("a.b <*> (x)", "a.b 7 (x)"), ("a.b", "axb"), (r"\E <*>", r"\E v"),
        ("<*> <*>", "one two three")], exact=False)
    assert got == [[("bob", "*")], None, [], [("7", "*")], None, [("v", "*")],
                   [("one", "*"), ("two three", "*")]]


def test_extract_exact_uses_patterns(spark):
    options = MinerOptions(masks=DEFAULT_MASKS)
    got = extract(spark, options, [
        ("from <IP> took <NUM> ms", "from 10.0.0.1 took 5 ms"),
        ("from <IP> took <NUM> ms", "from host took 5 ms"),
        ("slot<NUM>", "slot7"), ("<HEX>:<NUM>", "0xff:3")])
    assert got[0] == [("10.0.0.1", "IP"), ("5", "NUM")]
    # The pattern of NUM asks for a boundary before it, as the mask did.
    assert got[1] is None and got[2] is None
    assert got[3] == [("0xff", "HEX"), ("3", "NUM")]


def test_extract_same_name_twice_and_named_groups(spark):
    masks = (Mask(r"(?P<q>['\"]).*?(?P=q)", "STR"), Mask(r"\d+", "N"), Mask(r"[a-f]{2}", "N"))
    options = MinerOptions(masks=masks, mask_prefix="<:", mask_suffix=":>")
    got = extract(spark, options, [
        ("<:STR:> and <:STR:> <:N:>", "'a' and \"b\" ff"), ("x <:*:>", "x any thing")])
    assert got == [[("'a'", "STR"), ('"b"', "STR"), ("ff", "N")], [("any thing", "*")]]


def test_hidden_mask_gives_null(spark):
    options = MinerOptions(masks=TUNED_MASKS)
    got = extract(spark, options, [("get <URL> ok", "get a.b.c ok"), ("n <UNIT>", "n 5")])
    assert got == [[("a.b.c", "URL")], None]


def test_parameter_values_and_table(spark):
    lines = spark.createDataFrame([(i, "t", f"user u{i % 3} left") for i in range(9)]
                                  + [(9, "t", "bye")], "line_id int, template_id string, text string")
    templates = spark.createDataFrame([("t", "user <*> left")], "template_id string, template string")
    options = MinerOptions()
    values = [r["values"] for r in
              P.parameter_values(lines, templates, options).orderBy("line_id").collect()]
    assert values == [[f"u{i % 3}"] for i in range(9)] + [[]]
    table = P.parameter_table(P.extract_parameters(lines, templates, options, False), top=2).collect()
    assert {(r["value"], r["rank"], r["value_lines"], r["lines"], r["distinct_values"])
            for r in table} == {("u0", 1, 3, 9, 3), ("u1", 2, 3, 9, 3)}


def test_best_match_ties(spark):
    rows = [("l", "a", 4, 0.5, 0), ("l", "b", 4, 0.5, 2), ("l", "c", 4, 0.25, 3), ("m", "a", 4, 0.25, 0)]
    pairs = spark.createDataFrame(rows, "line string, template_id string, n int, sim double, params int")
    assert {(r["line"], r["template_id"]) for r in M.best_match(pairs, ["line"], 0.4).collect()} == {
        ("l", "b")}
    few = M.best_match(pairs, ["line"], 0.0, "fewest_wildcards").collect()
    assert [(r["line"], r["template_id"]) for r in few] == [("l", "a")]


def test_two_way(spark):
    kind = "line string, template_id string, sim double, params int"
    fw = spark.createDataFrame([("x", "f", 0.5, 1), ("y", "f", 0.5, 2), ("z", "f", 0.5, 1)], kind)
    rv = spark.createDataFrame([("x", "r", 0.5, 1), ("y", "r", 0.5, 1), ("z", "r", 0.7, 9), ("w", "r", 0.1, 0)], kind)
    got = {r["line"]: r["side"] for r in M.two_way_candidates(fw, rv, ["line"]).collect()}
    assert got == {"x": "prefix", "y": "suffix", "z": "suffix", "w": "suffix"}


def test_plan_has_no_cross_product(spark):
    shapes, templates = data()
    plan = M.match_lines(spark.createDataFrame(shapes, SHAPES),
                         spark.createDataFrame(templates, TEMPLATES), MinerOptions(), "fallback"
                         )._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F.lit(1) is not None


def test_near_pairs_hold_all_that_reach_the_threshold(spark):
    """In a crowded block all similar pairs are found, and not its product."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    blocks = {(6, "k"): 60, (6, "l"): 3, (13, "k"): 40, (0, ""): 2, (3, "k"): 20}
    shapes, templates = [], []
    for (n, key), count in blocks.items():
        for i in range(count):
            base = [key, *rng.choices(words, k=n - 1)] if n else []
            templates.append((f"t{n}{key}{i}", n, key, [w if rng.random() < 0.9 else "<*>" for w in base]))
            for j in range(3):
                shapes.append((f"s{n}{key}{i}_{j}", n, key, [
                    w if rng.random() < 0.8 else rng.choice([*words, "<*>"]) for w in base]))
    left = spark.createDataFrame(shapes, "shape_id string, n int, key string, tokens array<string>")
    right = spark.createDataFrame(templates, "template_id string, n int, key string, tokens array<string>")
    got = {(r["shape_id"], r["template_id"]) for r in M.near_pairs(left, right, ["n", "key"], 0.0, crowded=5).collect()}
    whole = {(s, t) for s, n, k, _ in shapes for t, m, q, _ in templates if (n, k) == (m, q)}
    near = set()
    for s, n, k, x in shapes:
        for t, m, q, y in templates:
            same = sum(a == b != "<*>" for a, b in zip(x, y))
            if (n, k) == (m, q) and (n == 0 or same / n >= round(1 - math.log2(n) / n, 1)):
                near.add((s, t))
    assert near <= got <= whole and len(got) < len(whole) / 4
