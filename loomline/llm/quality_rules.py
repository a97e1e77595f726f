"""Quality rules (9): one projection of counts and verdicts, compiled from a table of thresholds.

No user function, no shuffle and no window: every count is a function of one row,
so the operator is a map over the scan at any size, and a hot source or very long
text moves nothing. Work per document is O(n log n) in its words.

Defined results: a null or empty text has no words, all counts are 0 and it fails
the base rule; a text without line breaks is one line; repeated rows are judged
each for itself; all input columns are kept, except that counts replace input
columns of the same names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.common import HAS_WORD, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this are from or an at not have "
    "der die das und ist den dem mit von zu ein eine im auf nicht sich des als auch es "
    "le la les de des et un une du en que qui pour dans pas par sur est au il ce "
    "el los las del y en con por se una su para al lo como más o no").split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``metric`` is outside ``least`` … ``most``, if it has
    ``min_words`` words or more."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", least=2.0, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.2),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio", least=0.01, min_words=50),
)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more.

    Windows are sorted by hash; neighbours of equal hash are compared word by
    word, so a hash collision cannot count.
    """
    def window_at(at: Column) -> Column:
        return F.slice(w_ref[0], at, WINDOW)

    w_ref: list[Column] = []

    def of(w: Column) -> Column:
        w_ref.append(w)
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(keys, covered))

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(
            k.alias("k"), (i + 1).alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            let(ranked, spans))

    def spans(ranked: Column) -> Column:
        def same(e: Column, other: Column) -> Column:
            return F.coalesce((e["k"] == other["k"]) & (
                window_at(e["at"]) == window_at(other["at"])), F.lit(False))

        twice = F.filter(ranked, lambda e, j: same(e, F.get(ranked, j - 1))
                         | same(e, F.get(ranked, j + 1)))
        starts = F.sort_array(F.transform(twice, lambda e: e["at"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            starts, first,
            lambda acc, at: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
            lambda acc: acc["n"])

    return let(words, of)


def counts_of(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All counts of one text as a struct; the words are split once."""
    text = F.coalesce(text, F.lit(""))
    forms = sorted({f for w in stop_words for f in (w, w.capitalize())})
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))
    squeezed = F.translate(text, " \t\n\x0b\x0c\r", "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(squeezed).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
            .alias("n_symbols"),
            let(lines, lambda ls: F.struct(
                F.size(ls).cast("long").alias("all"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
            .alias("lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(forms))).cast("long").alias("n_stop_words"))

    return let(words_of(text), of)


def compile_rules(rules: Sequence[Rule], metrics: dict[str, Column], n_words: Column
                  ) -> dict[str, Column]:
    """A boolean Column for each rule: does the row break it?"""
    out = {}
    for rule in rules:
        value = metrics[rule.metric]
        sides = ([value < F.lit(rule.least)] if rule.least is not None else []) + (
            [value > F.lit(rule.most)] if rule.most is not None else [])
        broken = reduce(Column.__or__, sides, F.lit(False))
        out[rule.name] = F.coalesce(broken & (n_words >= rule.min_words), F.lit(False))
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
          stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_stop_words, base_failed, broken`` (names of broken rules) and ``kept``."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "base_failed", "broken", "kept"]
    carried = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    c = counts_of(F.col(text_col), stop_words)

    def verdict(x: Column) -> Column:
        n = x["n_words"]
        many = F.nullif(n.cast("double"), F.lit(0.0))
        metrics = {
            "mean_word_chars": x["word_chars"] / many,
            "symbol_ratio": x["n_symbols"] / many,
            "dup_line_ratio": x["lines"]["dup"] / F.nullif(x["lines"]["all"].cast("double"), F.lit(0.0)),
            "stop_word_ratio": x["n_stop_words"] / many,
        }
        broken = compile_rules(rules, metrics, n)
        base = (n < 10) | (F.lit(100) * x["n_repeat_words"] > F.lit(20) * n)
        names = F.filter(F.array(*[F.when(b, F.lit(name)) for name, b in broken.items()]),
                         lambda b: b.isNotNull())
        return F.struct(
            n.alias("n_words"), x["word_chars"].alias("word_chars"),
            x["n_symbols"].alias("n_symbols"), x["lines"]["dup"].alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"),
            x["n_stop_words"].alias("n_stop_words"), base.alias("base_failed"),
            names.alias("broken"), (~base & (F.size(names) == 0)).alias("kept"))

    judged = docs.select(*carried, F.inline(F.array(let(c, verdict))))
    return judged
