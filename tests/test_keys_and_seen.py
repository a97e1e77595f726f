"""Key history and seen tokens next to plain restatements."""

import itertools
import random
from collections import Counter, defaultdict

from loomline.operators import paths as K
from loomline.operators import seen as N
from loomline.options import MinerOptions

OPTIONS = MinerOptions(depth=6)  # keys of up to three tokens
MEMBERS = "template_id string, n int, tokens array<string>, cnt long"


def members(seed, count=200):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        n = rng.choice([0, 1, 2, 4, 6])
        rows.append((f"t{rng.randrange(12)}", n, [rng.choice(["a", "b", "c", "<*>", "x1", "y2"]) for _ in range(n)],
                     rng.randint(1, 3)))
    return rows


def key_of(tokens, numeric=True):
    length = max(min(OPTIONS.depth - 2, len(tokens)) - 1, 0)
    return tuple("<*>" if numeric and any(c.isdigit() for c in t) else t for t in tokens[:length])


def covers(general, key):
    return general != key and len(general) == len(key) and all(g in ("<*>", k) for g, k in zip(general, key))


def plain_history(rows):
    keys = {(t, n, key_of(tokens)) for t, n, tokens, _ in rows}
    return {k for k in keys if not any(o[:2] == k[:2] and covers(o[2], k[2]) for o in keys)}


def test_history_keeps_what_is_not_covered(spark):
    rows = members(1)
    got = K.add_keys(None, K.member_keys(spark.createDataFrame(rows, MEMBERS), OPTIONS), OPTIONS).collect()
    assert {(r["template_id"], r["n"], tuple(r["key"])) for r in got} == plain_history(rows)


def test_batches_and_merged_templates(spark):
    first, second = members(2, 60), members(3, 60)
    lineage = {"t1": "t0", "t5": "t4"}
    history = K.add_keys(None, K.member_keys(spark.createDataFrame(first, MEMBERS), OPTIONS, 0), OPTIONS)
    moved = spark.createDataFrame(list(lineage.items()), "template_id string, to_id string")
    got = K.add_keys(history, K.member_keys(spark.createDataFrame(second, MEMBERS), OPTIONS, 1), OPTIONS, moved).collect()
    old = {(lineage.get(t, t), n, k) for t, n, k in plain_history(first)}
    every = old | {(t, n, key_of(tokens)) for t, n, tokens, _ in second}
    want = {k for k in every if not any(o[:2] == k[:2] and covers(o[2], k[2]) for o in every)}
    assert {(r["template_id"], r["n"], tuple(r["key"])) for r in got} == want
    assert all(r["batch"] == (0 if (r["template_id"], r["n"], tuple(r["key"])) in old else 1) for r in got)


def test_walk_keeps_both_branches(spark):
    rows, shapes = members(4), members(5, 80)
    history = K.add_keys(None, K.member_keys(spark.createDataFrame(rows, MEMBERS), OPTIONS), OPTIONS)
    asked = spark.createDataFrame([(f"s{i}", n, tokens) for i, (_, n, tokens, _) in enumerate(shapes)],
                                  "shape_id string, n int, tokens array<string>")
    got = K.reached_templates(asked, history, OPTIONS).collect()
    want = set()
    for i, (_, n, tokens, _) in enumerate(shapes):
        head = key_of(tokens, False)
        for t, m, key in plain_history(rows):
            if m == n and (key == head or covers(key, head)):
                want.add((f"s{i}", t, "\x01".join(key)))
    assert {(r["shape_id"], r["template_id"], r["key"]) for r in got} == want
    best = {r["shape_id"]: r["literals"] for r in K.preferred(K.reached_templates(asked, history, OPTIONS)).collect()}
    for shape, literals in best.items():
        assert literals == max(sum(t != "<*>" for t in k.split("\x01")) if k else 0 for s, _, k in want if s == shape)


def test_wildcards_only_for_tokens_that_stood_there(spark):
    rows = [("t0", 2, ["x1", "z"], 1), ("t1", 2, ["a", "z"], 1)]
    history = K.add_keys(None, K.member_keys(spark.createDataFrame(rows, MEMBERS), OPTIONS), OPTIONS)
    asked = spark.createDataFrame([("s0", 2, ["x1", "q"]), ("s1", 2, ["b", "q"])], "shape_id string, n int, tokens array<string>")
    seen = spark.createDataFrame([(2, 0, "x1")], "n int, level int, token string")
    every = {(r["shape_id"], r["template_id"]) for r in K.reached_templates(asked, history, OPTIONS).collect()}
    strict = {(r["shape_id"], r["template_id"]) for r in K.reached_templates(asked, history, OPTIONS, seen).collect()}
    assert every == {("s0", "t0"), ("s1", "t0")} and strict == {("s0", "t0")}


def test_a_template_is_found_only_by_an_old_key(spark):
    came = spark.createDataFrame([("t", 3, ["start", "pump", "a"], 1), ("t", 3, ["stop", "pump", "b"], 1)], MEMBERS)
    folded = spark.createDataFrame([("t", 3, ["<*>", "pump", "<*>"], 2)], MEMBERS)
    asked = spark.createDataFrame([("s", 3, ["start", "pump", "z"])], "shape_id string, n int, tokens array<string>")
    literal = OPTIONS.with_(numeric_tokens=False)
    old = K.add_keys(None, K.member_keys(came, literal), literal)
    assert [r["template_id"] for r in K.reached_templates(asked, old, OPTIONS).collect()] == ["t"]
    now = K.member_keys(folded, literal)
    fresh = spark.createDataFrame([("u", 3, ["start", "pump", "c"], 1)], MEMBERS)
    both = K.add_keys(K.add_keys(None, now, literal), K.member_keys(fresh, literal, 1), literal)
    assert {r["template_id"] for r in K.reached_templates(asked, both, OPTIONS).collect()} == {"t", "u"}


def test_a_capped_key_is_remembered(spark):
    """A template whose rare first token stood for the wildcard is found by other rare tokens."""
    rows = [("t0", 3, ["often", "b", "c"], 9), ("t1", 3, ["rare", "b", "c"], 1), ("t2", 3, ["scarce", "b", "c"], 1)]
    options = MinerOptions(depth=4, max_children=2)
    members = spark.createDataFrame(rows, MEMBERS)
    history = K.add_keys(None, K.member_keys(members, options, capped=True), options)
    asked = spark.createDataFrame([("s", 3, ["new", "b", "c"]), ("o", 3, ["often", "b", "x"])],
                                  "shape_id string, n int, tokens array<string>")
    found = {(r["shape_id"], r["template_id"]) for r in K.reached_templates(asked, history, options).collect()}
    assert found == {("s", "t1"), ("s", "t2"), ("o", "t0"), ("o", "t1"), ("o", "t2")}
    assert K.reached_templates(asked, K.member_keys(members, options), options).filter("shape_id = 's'").count() == 0


def plain_seen(rows):
    out = Counter()
    for t, _, tokens, cnt in rows:
        for pos, token in enumerate(tokens):
            out[t, pos, token] += cnt
    return out


def state_of(df):
    return {(r["template_id"], r["pos"], r["token"]): r["lines"] for r in df.collect()}


def test_seen_tokens_merge_across_batches_and_folds(spark):
    batches = [members(s, 70) for s in (6, 7, 8)]
    states = [N.seen_tokens(spark.createDataFrame(b, MEMBERS)) for b in batches]
    assert state_of(N.merge_seen(*states)) == plain_seen(itertools.chain(*batches))
    lineage = {f"t{i}": f"t{i % 3}" for i in range(9)}
    moved = N.move_seen(N.merge_seen(*states), spark.createDataFrame(list(lineage.items()), "template_id string, to_id string"))
    assert state_of(moved) == plain_seen((lineage.get(t, t), n, x, c) for t, n, x, c in itertools.chain(*batches))
    assert N.seen_tokens(spark.createDataFrame([], MEMBERS)).count() == 0


def test_seen_similarity(spark):
    rng, rows = random.Random(9), members(9, 60)
    seen = defaultdict(set)
    for (t, pos, token), _ in plain_seen(rows).items():
        seen[t, pos].add(token)
    pairs = []
    for i in range(150):
        n = rng.choice([0, 1, 4])
        pairs.append((f"t{rng.randrange(12)}", f"s{i}", [rng.choice(["a", "<*>", "<NUM>", "b"]) for _ in range(n)],
                      [rng.choice(["a", "b", "c", "x1", "<*>", "new"]) for _ in range(n)]))
    got = N.seen_similarity(spark.createDataFrame(pairs, "template_id string, shape_id string, t array<string>, tokens array<string>"),
                            N.seen_tokens(spark.createDataFrame(rows, MEMBERS))).collect()
    want = {}
    for t, s, template, tokens in pairs:
        same = sum(a == b for a, b in zip(template, tokens))
        params = sum(a != b and (a[:1] == "<" or b[:1] == "<") and b in seen[t, i]
                     for i, (a, b) in enumerate(zip(template, tokens)))
        want[s] = (params, (same + params) / len(tokens) if tokens else 1.0)
    assert {r["shape_id"]: (r["params"], r["sim"]) for r in got} == want
