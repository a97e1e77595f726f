import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import masks as K
from loomline.functions import similarity as S
from loomline.functions import tokens as T
from loomline.functions.patterns import header_pattern
from loomline.operators import lines as L
from loomline.options import DEFAULT_MASKS, Mask, MinerOptions, TUNED_MASKS


def one(spark, column_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column_of(F.col("v")).alias("o")).orderBy("i").collect()]


def test_tokenize(spark):
    got = one(spark, lambda c: T.tokenize(c, ["_"]), ["  a_b  c ", "", "   ", "é b\tc", "x"])
    assert got == [["a", "b", "c"], [], [], ["é", "b", "c"], ["x"]]


def test_delimiters_are_literal(spark):
    assert one(spark, lambda c: T.tokenize(c, ["."]), ["a.b*c"]) == [["a", "b*c"]]


PUNCT = {
    "key=val,": ["key", "=", "val", ","],
    "10.0.0.1:80": ["10.0.0.1:80"],
    "10:23:35": ["10:23:35"],
    "a=b:c": ["a", "=", "b", ":", "c"],
    "a:b=c=d": ["a", ":", "b", "=", "c=d"],
    "a=b:c:d": ["a", "=", "b", ":", "c:d"],
    "a=b=c": ["a=b=c"],
    "a:b:c": ["a:b:c"],
    "=x": ["=", "x"],
    ",,": [",,"],
    "(done).": ["(done)", "."],
    "::a=b!?": ["::", "a", "=", "b", "!?"],
    "<NUM>": ["<NUM>"],
    "<NUM>,": ["<NUM>", ","],
    "x <IP>:80 y": ["x", "<IP>", ":", "80", "y"],
}


def test_tokenize_punct(spark):
    assert dict(zip(PUNCT, one(spark, T.tokenize_punct, list(PUNCT)))) == PUNCT


MASKED = {
    "Receive message 0x15 from 188.23.3.34 to 129.199.2.1":
        "Receive message <HEX> from <URL> to <URL>",
    "slot A12 failed on board": "slot<SLOT>failed on board",
    "open /var/log/a.log?x=1 now": "open <PATH> now",
    "http://a.b.com:80/x/y took 12 sec 3 KB": "http<PATH> took <HEX> <UNIT> <HEX> <UNIT>",
    "a bad face -5 +7 1 2 3": "<HEX> <HEX> <HEX> -<HEX> +<HEX> <HEX> <HEX> <HEX>",
    "Tue Jan 2 10:11:12 CET 2024 ok": "<DATE> ok",
    "<*> <*> <*> x": "<*> x",
    "mac aa:bb:cc:dd:ee up": "mac <ID> up",
    'executed cmd "ls -l /tmp" done': 'executed cmd "ls -l <PATH> done',
}


def test_masks_golden(spark):
    got = one(spark, lambda c: K.mask_text(c, TUNED_MASKS), list(MASKED))
    assert dict(zip(MASKED, got)) == MASKED


@pytest.mark.parametrize("masks", [TUNED_MASKS, DEFAULT_MASKS])
def test_masks_agree_with_re(spark, masks):
    samples = [*MASKED, "é1 ٣٤ 12é 7", "x-5.5 10.0.0.1:80 0xFF", "1 2 3 -4 +5-6", "ñ.b.c/d", "$5 \\1"]
    want = []
    for text in samples:
        for m in masks:
            text = re.sub(m.pattern, f"<{m.name}>", text)
        want.append(text)
    assert one(spark, lambda c: K.mask_text(c, masks), samples) == want


def test_mask_text_escapes_and_callable(spark):
    masks = [Mask("a", "$1"), Mask("", "UP", apply=F.upper)]
    assert one(spark, lambda c: K.mask_text(c, masks, "<:", ":>"), ["bat"]) == ["B<:$1:>T"]


def test_delete_then_replace(spark):
    text = one(spark, lambda c: K.replace_patterns(K.delete_patterns(c, [r" \(\d+\)"]), [r"\d+"]),
               ["sent 5 (12) to 7"])
    assert text == ["sent <*> to <*>"]


def test_mask_profile_shows_dead_masks(spark):
    lines = spark.createDataFrame([("1 2 10.0.0.1",), ("no",)], "text string")
    rows = {r["mask_name"]: (r["lines_hit"], r["matches"])
            for r in L.mask_profile(lines, TUNED_MASKS).collect()}
    assert rows["URL"] == (1, 1) and rows["HEX"] == (1, 2)
    assert rows["IP"] == (0, 0) and rows["NUM"] == (0, 0)


def test_token_flags(spark):
    values = ["IPV4", "=", "Ab", "snake_case", "camelCase", "a::b", "<NUM>x", "/etc", "x²"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    flags = L.token_flags(F.col("t"))
    rows = {r["t"]: r for r in df.select("t", *[c.alias(n) for n, c in flags.items()]).collect()}
    assert [rows[v]["all_caps"] for v in values[:3]] == [True, True, False]
    assert rows["snake_case"]["snake_or_camel"] and rows["camelCase"]["snake_or_camel"]
    assert rows["a::b"]["scoped_name"] and rows["<NUM>x"]["mask"] and rows["/etc"]["path_mark"]
    assert rows["x²"]["digit"] and not rows["camelCase"]["digit"]


def test_key_lengths(spark):
    n = [0, 1, 2, 4, 5, 6, 20]
    assert one(spark, lambda c: T.prefix_key_length(c, 10), n, "int") == [0, 0, 1, 3, 4, 5, 7]
    assert one(spark, lambda c: T.suffix_key_length(c, 400), n, "int") == [0, 1, 2, 3, 3, 4, 11]
    assert one(spark, lambda c: T.suffix_key_length(c, 4), n, "int") == [0, 1, 1, 1, 1, 1, 1]


def test_dynamic_threshold(spark):
    got = one(spark, S.dynamic_threshold, [0, 1, 2, 4, 8, 16], "int")
    assert got == [1.0, 1.0, 0.5, 0.5, 0.6, 0.8]


def test_header_pattern_numbers_fields_only():
    names, regex = header_pattern(r"<A> <B>(\[<P>\])?: <Content>")
    assert names == ["A", "B", "P", "Content"]
    assert regex.endswith(r"^(?<f0>.*?)\s+(?<f1>.*?)(\[(?<f2>.*?)\])?:\s+(?<f3>.*?)$")


def test_options_are_checked():
    with pytest.raises(ValueError):
        MinerOptions(depth=2)
    with pytest.raises(ValueError):
        MinerOptions(prefer="some")


def test_token_dictionary(spark):
    lines = spark.createDataFrame([(1, "disk a full"), (2, "disk b full"), (3, "a a")],
                                  "line_id long, text string")
    shapes = L.distinct_shapes(L.with_tokens(lines, MinerOptions()))
    rows = {r["token"]: r for r in L.token_dictionary(shapes).collect()}
    assert (rows["a"]["lines"], rows["a"]["occurrences"], rows["a"]["positions"]) == (2, 3, 2)
    assert rows["disk"]["in_vocab"] and not rows["b"]["in_vocab"]
    lexicon = spark.createDataFrame([("b",)], "token string")
    listed = {r["token"]: r["in_vocab"] for r in L.token_dictionary(shapes, lexicon=lexicon).collect()}
    assert listed == {"disk": False, "a": False, "b": True, "full": False}


def test_annotate_tokens_keeps_order(spark):
    shapes = spark.createDataFrame([("s", ["b", "a", "zz"]), ("e", [])],
                                   "shape_id string, tokens array<string>")
    lexicon = spark.createDataFrame([("a", "VB"), ("b", "NN")], "token string, tag string")
    rows = {r["shape_id"]: r["tag"] for r in L.annotate_tokens(shapes, lexicon, ["tag"]).collect()}
    assert rows == {"s": ["NN", "VB", None], "e": []}
