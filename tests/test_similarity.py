"""Column rules against a plain restatement on random token pairs."""

import random
import re

from pyspark.sql import functions as F

from loomline.functions import similarity as S

WORDS = ["alpha", "beta", "GO", "STOP", "x1", "12", "IPV4", "snake_a", "camelCase", "a::b", "=",
         ":", ",", ".", "<NUM>", "<*>", "is", "to", "/etc", "Ab"]
TAGS = ["NN", "VB", "JJ", "IN", "TO", "DT", "CD", "NNS"]


def pairs(count=1200, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        n = rng.choice([0, 1, 1, 2, 3, 4, 6])
        a = [rng.choice(WORDS) for _ in range(n)]
        b = [t if rng.random() < 0.6 else rng.choice(WORDS) for t in a]
        vocab = [[rng.random() < 0.7 for _ in range(n)] for _ in range(2)]
        tags = [[rng.choice(TAGS) for _ in range(n)] for _ in range(2)]
        seen = [[t] + rng.sample(WORDS, 3) for t in a]
        out.append((i, a, b, vocab[0], vocab[1], tags[0], tags[1], seen))
    return out


SCHEMA = ("i int, a array<string>, b array<string>, va array<boolean>, vb array<boolean>, "
          "ta array<string>, tb array<string>, seen array<array<string>>")


def digit(t):
    return any(c.isdigit() for c in t)


def caps(t):
    return not any(c.isalpha() and not c.isupper() for c in t)


def named(t):
    return bool(re.fullmatch(r"[a-z]+(_[a-z]+)+", t) or re.fullmatch(r"[a-zA-Z]+([A-Z][a-z0-9]+)+", t))


def open_places(a, b):
    for i, (s, t) in enumerate(zip(a, b)):
        masked = re.search("<[^:]+>", s) or re.search("<[^:]+>", t)
        if s != t and not masked and ((not digit(s) and not digit(t)) or (caps(s) and caps(t))):
            yield i, s, t


def get(seq, i):
    return seq[i] if 0 <= i < len(seq) else ""


def static(a, b):
    n = len(a)
    for i, s, t in open_places(a, b):
        inner = 0 < i < n - 1
        colon = ":" in (get(a, i - 1), get(b, i - 1))
        mark = {get(a, i + 1), get(b, i + 1)} & {",", ".", ":"}
        value = get(b, i + 1) in ("=", ":")
        function = any(re.fullmatch("[^:]+::[^:]+", x) for x in (s, t))
        if (n == 1 or (named(s) and named(t)) or (inner and value)
                or (i == 0 and (value or function))
                or (inner and colon and not mark and caps(s) and caps(t))
                or (0 < i == n - 1 and colon and caps(s) and caps(t)) or caps(s) or caps(t)):
            return True
    return False


def known(a, b, va, vb, ta):
    for i, _, _ in open_places(a, b):
        if not (0 < i < len(a) - 1 and va[i] and vb[i]):
            continue
        framed = a[i - 1] == b[i - 1] and a[i + 1] == b[i + 1] and ta[i - 1] not in ("IN", "TO")
        value = ({a[i - 1], b[i - 1]} & {"=", ":"}) and ({a[i + 1], b[i + 1]} & {",", ".", ":"})
        if framed or value:
            return True
    return False


def speech(a, b, ta, tb):
    small = ("CC", "DT", "EX", "FW", "IN", "LS", "MD", "PDT", "POS", "PRP", "RB", "RP", "SYM",
             "TO", "UH")
    for i, s, t in open_places(a, b):
        x, y = ta[i], tb[i]
        if any(k in x or k in y for k in small) or x[0] != y[0]:
            return True
        if not any(k in g for k in ("VB", "JJ", "NN") for g in (x, y)):
            continue
        plain = not set("_/") & set(s + t)
        before = [(get(a, i - 1), get(ta, i - 1)), (get(b, i - 1), get(tb, i - 1))]
        free = all(w not in (":", "=") and g not in ("IN", "TO") for w, g in before)
        lead_in = before[0][0] == before[1][0] and any(g[:2] in ("JJ", "VB") for _, g in before)
        if i == 0 and plain and not any(get(g, 1).startswith("VB") for g in (ta, tb)):
            return True
        if i > 0 and free and plain and not (digit(s) and digit(t)) and not lead_in:
            return True
        if i > 0 and "VB" in x and before[0][1] in ("IN", "TO"):
            return True
    return False


def test_rules_match_restatement(spark):
    data = pairs()
    df = spark.createDataFrame(data, SCHEMA)
    a, b = F.col("a"), F.col("b")
    rows = {r["i"]: r for r in df.select(
        "i", S.positional_similarity(a, b).alias("m1"),
        S.positional_similarity(a, b, include_params=True).alias("m1p"),
        S.seen_token_similarity(a, b, F.col("seen")).alias("m2"),
        S.static_position_veto(a, b).alias("m3"),
        S.dictionary_veto(a, b, F.col("va"), F.col("vb"), F.col("ta")).alias("m4"),
        S.pos_veto(a, b, F.col("ta"), F.col("tb")).alias("m5"),
        S.merge_pair(a, b).alias("g1")).collect()}
    hits = [0, 0, 0]
    for i, x, y, va, vb, ta, tb, seen in data:
        n, r = len(x), rows[i]
        params = x.count("<*>")
        same = sum(s == t != "<*>" for s, t in zip(x, y))
        assert tuple(r["m1"]) == ((same / n if n else 1.0), params)
        assert r["m1p"]["sim"] == ((same + params) / n if n else 1.0)
        masked = sum(s != t and bool(re.match("<[^:]+>", s) or re.match("<[^:]+>", t)) and t in z
                     for s, t, z in zip(x, y, seen))
        equal = sum(s == t for s, t in zip(x, y))
        assert tuple(r["m2"]) == (((equal + masked) / n if n else 1.0), masked)
        want = static(x, y), known(x, y, va, vb, ta), speech(x, y, ta, tb)
        assert (r["m3"], r["m4"], r["m5"]) == want, (x, y, ta, tb)
        hits = [h + w for h, w in zip(hits, want)]
        assert r["g1"] == [s if s == t else "<*>" for s, t in zip(x, y)]
    assert min(hits) > 10 and max(hits) < len(data) - 10


def test_merge_is_a_semilattice(spark):
    df = spark.createDataFrame(pairs(100, 3), SCHEMA).withColumn(
        "c", F.transform("a", lambda t, i: F.when(i % 2 == 0, "alpha").otherwise(t)))
    m = S.merge_pair
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    wrong = df.filter((m(a, b) != m(b, a)) | (m(a, a) != a) | (m(m(a, b), c) != m(a, m(b, c))))
    assert wrong.count() == 0
