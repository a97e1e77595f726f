"""Phrase collocation mining (11): best-first growth of phrases under score bounds.

A phrase of 2 to 4 words that occurs ``least`` times scores by its lowest-scoring cut
into a first part and a rest, ``floor(2000000 * a / (l + r))``. A phrase that another
candidate, one word longer, holds in ``cover`` percent of its occurrences is dropped.

Phrases grow by one word from a frontier of prefixes. A phrase occurs at most as often as
its prefix, and the rest after its first word at least as often as the phrase, so no
phrase that starts with ``q`` scores above

    bound(q) = floor(2000000 * f(q) / (f(first word of q) + f(q)))

Prefixes are taken in falling order of the bound, a batch a round: each language has a
``cut``, and prefixes with a bound of at least the cut are expanded. Phrases that score
at least the cut are settled, which means that their extensions to the left are counted
too (those to the right are, as their score is at most their bound). Then all phrases
that score at least the cut are known, and whether they survive. A language is done once
``top`` of them survive; the others go on with a lower cut, at last 0. Of four words
``1234`` the count of ``234`` may be missing, since ``234`` may be no worthy prefix; it is
requested and counted only if all else known of ``1234`` leaves it above the cut.

One pass over the texts counts single words; a second one stores the texts as codes of
words, frequent ones only, with breaks between. All later passes read these codes and
count inside a batch before rows leave it. Which words or prefixes a pass counts is told
to tasks by bit sets over hashes: their size is fixed by ``filter_bits``, and as they let
a few more through, never fewer, what is counted is exact and is joined with the exact
tables afterwards. A word goes by a 64-bit hash of language and word; the first pass
proves that no two words share one, or takes another seed.

Defined results: null and empty texts hold no words; a null ``lang`` is ``und``; ids are
not used, so repeated rows and null ids count like others; texts are processed whole; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.common import give_back, rows_at_once
from loomline.operators.ranking import top_per_group
from loomline.session import release, stage

# Characters that end a piece; a tab is a blank.
BREAKS = b",;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(BREAKS + b"\t", b"." * len(BREAKS) + b" ")
SCALE = 2_000_000
HIGHEST = SCALE + 1
BATCH_BYTES = 2 << 20  # texts of one row of codes
TEXTS_AT_ONCE, CODES_AT_ONCE = 1000, 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    least: int = 30
    cover: int = 80
    top: int = 2000
    filter_bits: int = 25


def words_and_breaks(text: bytes | None) -> list[bytes]:
    """Lower-case words in order; ``.`` stands for a break between pieces."""
    return (text or b"").lower().translate(PLAIN).replace(b".", b" . ").split()


def word_hashes(words: list[bytes], lang: bytes, seed: int) -> np.ndarray:
    """Odd 64-bit hashes of words in a language, so that 0 is free for breaks."""
    own = xxhash.xxh3_64_intdigest(lang, seed)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(own)), np.uint64, len(words))
    return hashed | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined_hash(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of word hashes, for bit sets only."""
    out = parts[0]
    for more in parts[1:]:
        out = mixed(out * GOLDEN + more)
    return out


class BitSet:
    """A set of hashes of fixed size; may hold others too."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.shift, self.data = np.uint64(64 - bits), data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = mixed(hashes) >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def bit_set(rows: DataFrame, columns: Sequence[str], rules: Rules) -> tuple[BitSet, int]:
    """The set of hashes of ``columns`` and the number of rows. Tasks turn hashes into
    bit positions, Spark joins them to bit maps; the driver gets at most
    ``2**filter_bits`` bits."""
    count = rows.count()
    bits = min(rules.filter_bits, max(15, (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            at = np.unique(mixed(joined_hash(parts)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])
        give_back()

    data = np.zeros(1 << (bits - 3), dtype=np.uint8)
    if count:
        maps = rows.select(*columns).mapInArrow(run, "at long").groupBy(
            F.shiftright("at", 15).alias("bucket")).agg(
            F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("map"))
        for row in maps.toLocalIterator():
            data[row["bucket"] << 12:(row["bucket"] + 1) << 12] = np.frombuffer(row["map"], np.uint8)
    return BitSet(bits, data), count


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes | None]]]:
    """``(lang, text)`` rows in lists of about ``BATCH_BYTES``."""
    rows, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            rows.append((lang, text))
            size += len(text or b"")
            if size >= BATCH_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def count_words(texts: DataFrame, rules: Rules) -> tuple[DataFrame, int]:
    """``(h, lang, word, f)`` of all words, and the seed that keeps their hashes apart."""
    for seed in range(8):
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for rows in sliced(batches):
                counts: dict[bytes, Counter] = {}
                for lang, text in rows:
                    counts.setdefault(lang, Counter()).update(words_and_breaks(text))
                for lang, some in counts.items():
                    words = list(some)
                    h = word_hashes(words, lang, seed).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array([lang] * len(words), pa.binary()), pa.array(words, pa.binary()),
                         pa.array(list(some.values()), pa.int64())], ["h", "lang", "word", "f"])
            give_back()

        named = F.struct("lang", "word")
        words = stage(texts.mapInArrow(run, "h long, lang binary, word binary, f long").groupBy("h").agg(
            F.min(named).alias("lo"), F.max(named).alias("hi"), F.sum("f").alias("f"))
            .select("h", "lo.*", "f", (F.col("lo") != F.col("hi")).alias("shared")), "words")
        if words.filter("shared").isEmpty():
            return words.drop("shared"), seed
        release(words)
    raise RuntimeError("two words share a hash under every seed")


def code_texts(texts: DataFrame, frequent: BitSet, seed: int) -> DataFrame:
    """``(names, codes)``: hashes of a batch's words, and its texts as places in them; 0
    is a break, which rare words are too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            parts = []
            for lang, text in rows:
                words = words_and_breaks(text)
                if len(words) > 1:
                    h = word_hashes(words, lang, seed)
                    h[h == word_hashes([b"."], lang, seed)[0]] = 0
                    parts += [h, np.zeros(1, np.uint64)]
            if not parts:
                continue
            h = np.concatenate(parts)
            h[~frequent.holds(h)] = 0
            live = h != 0
            live[1:] |= live[:-1]  # one break after each run
            names, codes = np.unique(np.append(h[live], np.uint64(0)), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names.tobytes()], pa.binary()), pa.array([codes.astype(np.uint32).tobytes()], pa.binary())],
                ["names", "codes"])
        give_back()

    return texts.mapInArrow(run, "names binary, codes binary")


def place_ids(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, int]:
    """One integer for equal rows of ``columns``, exactly, and a bound of them."""
    ids, bound = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for more in columns[1:]:
        width = int(more.max()) + 1
        if bound * width >= 1 << 62:
            ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
            bound = int(ids.max()) + 1
        ids, bound = ids * width + more, bound * width
    return ids, bound


def count_phrases(coded: DataFrame, m: int, rules: Rules, pairs: BitSet | None = None,
                  prefixes: BitSet | None = None, suffixes: BitSet | None = None,
                  exactly: BitSet | None = None) -> DataFrame:
    """``(h1..hm, a)`` of phrases of ``m`` words that occur ``least`` times: of frequent
    ``pairs`` throughout, and with a prefix in ``prefixes``, a suffix in ``suffixes`` or
    themselves in ``exactly``."""
    names_of = [f"h{k}" for k in range(1, m + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, codes in zip(batch.column(0), batch.column(1)):
                names = np.frombuffer(names.as_buffer(), np.uint64)
                codes = np.frombuffer(codes.as_buffer(), np.uint32)
                at = len(codes) - m + 1
                if at <= 0:
                    continue
                use = codes != 0
                linked = use[:-1] & use[1:]
                if pairs is not None:
                    here = np.nonzero(linked)[0]
                    linked[here] = pairs.holds(joined_hash([names[codes[here]], names[codes[here + 1]]]))
                use = linked[:at].copy()
                for k in range(1, m - 1):
                    use &= linked[k:k + at]
                here = np.nonzero(use)[0]
                if m > 2:
                    h = [names[codes[here + k]] for k in range(m)]
                    wanted = np.zeros(len(here), dtype=bool)
                    for chosen, parts in ((prefixes, h[:-1]), (suffixes, h[1:]), (exactly, h)):
                        if chosen is not None:
                            wanted |= chosen.holds(joined_hash(parts))
                    here = here[wanted]
                if not len(here):
                    continue
                ids, _ = place_ids([codes[here + k] for k in range(m)])
                _, first, count = np.unique(ids, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(names[codes[here[first] + k]].view(np.int64)) for k in range(m)),
                     pa.array(count.astype(np.int64))], [*names_of, "a"])
        give_back()

    schema = ", ".join(f"{c} long" for c in [*names_of, "a"])
    return coded.mapInArrow(run, schema).groupBy(*names_of).agg(F.sum("a").alias("a")).filter(
        F.col("a") >= rules.least)


def ratio(a: Column, l: Column, r: Column) -> Column:
    """``floor(2000000 * a / (l + r))`` in exact arithmetic."""
    big, by = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)"), (l + r).cast("decimal(20,0)")
    return ((big - big % by) / by).cast("long")


def lowest_cut(a: Column, cuts: Sequence[tuple[Column, Column]]) -> Column:
    """``(score, k, l, r)`` of the lowest-scoring cut, the first of equals."""
    return F.array_min(F.array(*[
        F.struct(ratio(a, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
        for k, (l, r) in enumerate(cuts, start=1)]))


def bound(a: Column, first: Column) -> Column:
    return ratio(a, first, a)


def known_pairs(counted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs with their language, the counts of their words, score and bound."""
    one = vocabulary.select(F.col("h").alias("h1"), "lang", F.col("f").alias("f1"))
    two = vocabulary.select(F.col("h").alias("h2"), F.col("f").alias("f2"))
    c = F.col
    return counted.join(one, "h1").join(two, "h2").select(
        "lang", "h1", "h2", "a", "f1", "f2", lowest_cut(c("a"), [(c("f1"), c("f2"))]).alias("cut"),
        bound(c("a"), c("f1")).alias("bound"))


def known_triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    c = F.col
    left = pairs.select("lang", "h1", "h2", c("a").alias("f12"), "f1")
    right = pairs.select(c("h1").alias("h2"), c("h2").alias("h3"), c("a").alias("f23"), c("f2").alias("f3"))
    return counted.join(left, ["h1", "h2"]).join(right, ["h2", "h3"]).select(
        "lang", "h1", "h2", "h3", "a", "f1",
        lowest_cut(c("a"), [(c("f1"), c("f23")), (c("f12"), c("f3"))]).alias("cut"),
        bound(c("a"), c("f1")).alias("bound"))


def known_fours(counted: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Phrases of four words; ``cut`` takes a missing part as ``a``, its least, and
    ``missing`` says that ``234`` is one."""
    c = F.col
    left = pairs.select("lang", "h1", "h2", c("a").alias("f12"), "f1")
    right = pairs.select(c("h1").alias("h3"), c("h2").alias("h4"), c("a").alias("f34"), c("f2").alias("f4"))
    first = triples.select("h1", "h2", "h3", c("a").alias("f123"))
    rest = triples.select(c("h1").alias("h2"), c("h2").alias("h3"), c("h3").alias("h4"), c("a").alias("f234"))
    return counted.join(left, ["h1", "h2"]).join(right, ["h3", "h4"]).join(
        first, ["h1", "h2", "h3"], "left").join(rest, ["h2", "h3", "h4"], "left").select(
        "lang", "h1", "h2", "h3", "h4", "a", lowest_cut(c("a"), [
            (c("f1"), F.coalesce("f234", "a")), (c("f12"), c("f34")), (F.coalesce("f123", "a"), c("f4"))]).alias("cut"),
        c("f234").isNull().alias("missing"))


def uncovered(phrases: DataFrame, longer: DataFrame, m: int, rules: Rules) -> DataFrame:
    """Phrases of ``m`` words that no candidate of one word more covers."""
    keys = [f"h{k}" for k in range(1, m + 1)]
    sides = [longer.select(*[F.col(f"h{k + s}").alias(f"h{k}") for k in range(1, m + 1)], F.col("a").alias("b"))
             for s in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("b").alias("b"))
    covered = F.col("b") * 100 >= F.col("a") * rules.cover
    return phrases.join(most, keys, "left").filter(~F.coalesce(covered, F.lit(False)))


def next_cuts(pairs: DataFrame, open_: DataFrame, taken: int) -> DataFrame:
    """``(lang, cut, before)`` of open languages: the score of the pair at rank ``taken``
    below the cut so far; 0 where fewer pairs are left."""
    able = pairs.select("lang", "h1", F.col("cut.score").alias("score")).join(open_, "lang").filter(
        F.col("score") < F.col("before"))
    top = top_per_group(able, ["lang"], [F.desc("score")], taken, F.col("h1"))
    at = top.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    cut = F.when(F.col("n") < taken, F.lit(0)).otherwise(F.col("score"))
    return open_.join(at, "lang", "left").select("lang", F.coalesce(cut, F.lit(0)).cast("long").alias("cut"), "before")


def mine_phrases(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` surviving phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    spark = docs.sparkSession
    with rows_at_once(spark, TEXTS_AT_ONCE):
        words, seed = count_words(texts, rules)
    spoken = words.filter(F.col("word") != F.lit(b"."))
    totals = stage(spoken.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    vocabulary = stage(spoken.filter(F.col("f") >= rules.least), "vocabulary")
    release(words)
    frequent, _ = bit_set(vocabulary, ["h"], rules)
    with rows_at_once(spark, TEXTS_AT_ONCE):
        coded = stage(code_texts(texts, frequent, seed), "codes")
    with rows_at_once(spark, CODES_AT_ONCE):
        pairs = stage(count_phrases(coded, 2, rules), "pairs")
    pairs = stage(known_pairs(pairs, vocabulary), "pairs")
    able, _ = bit_set(pairs, ["h1", "h2"], rules)

    triples = fours = None
    cuts, taken = totals.select("lang", F.lit(HIGHEST).cast("long").alias("before")), 2 * rules.top
    settled: list[DataFrame] = []
    while True:
        cuts = stage(next_cuts(pairs, cuts, taken), "cuts")
        taken *= 4
        triples = grown(triples, count_triples(coded, pairs, cuts, able, rules), 3)
        more, fresh = count_fours(coded, pairs, triples, cuts, able, rules)
        if more is not None:
            triples = grown(triples, more, 3)
        fours = grown(fours, fresh, 4)
        known = known_fours(fours, pairs, triples).filter("NOT missing").drop("missing")
        alive = None
        for some, m, longer in ((pairs, 2, triples), (triples, 3, fours), (known, 4, None)):
            good = within(some, cuts, "cut.score")
            if longer is not None:
                good = uncovered(good, longer, m, rules)
            good = good.select("lang", F.array(*[f"h{k}" for k in range(1, m + 1)]).alias("h"), "a", "cut.l", "cut.r",
                               "cut.score")
            alive = good if alive is None else alive.unionByName(good)
        settled.append(stage(alive, "settled"))
        survivors = settled[0]
        for s in settled[1:]:
            survivors = survivors.unionByName(s)
        have = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
        cuts = stage(cuts.join(have, "lang", "left").filter(
            (F.col("cut") > 0) & (F.coalesce("have", F.lit(0)) < rules.top))
            .select("lang", F.col("cut").alias("before")), "open")
        if cuts.isEmpty():
            break
    release(coded, pairs, triples, fours)
    return ranked(survivors, vocabulary, totals, rules)


def grown(old: DataFrame | None, fresh: DataFrame, m: int) -> DataFrame:
    """Both tables as one; a phrase counted twice was counted alike."""
    if old is None:
        return fresh
    both = stage(old.unionByName(fresh).dropDuplicates([f"h{k}" for k in range(1, m + 1)]), "phrases")
    release(old, fresh)
    return both


def within(rows: DataFrame, cuts: DataFrame, value: str) -> DataFrame:
    """Rows with ``cut <= value < before`` in their language."""
    now = cuts.select("lang", F.col("cut").alias("_cut"), F.col("before").alias("_before"))
    return rows.join(now, "lang").filter(
        (F.col(value) >= F.col("_cut")) & (F.col(value) < F.col("_before"))).drop("_cut", "_before")


def count_triples(coded: DataFrame, pairs: DataFrame, cuts: DataFrame, able: BitSet, rules: Rules) -> DataFrame:
    """Extensions of the pairs of this round."""
    expand, _ = bit_set(within(pairs, cuts, "bound"), ["h1", "h2"], rules)
    settle, _ = bit_set(within(pairs, cuts, "cut.score"), ["h1", "h2"], rules)
    with rows_at_once(coded.sparkSession, CODES_AT_ONCE):
        counted = stage(count_phrases(coded, 3, rules, able, expand, settle), "triples")
    return stage(known_triples(counted, pairs), "triples")


def count_fours(coded: DataFrame, pairs: DataFrame, triples: DataFrame, cuts: DataFrame, able: BitSet, rules: Rules
                ) -> tuple[DataFrame | None, DataFrame]:
    """The triples that the scores of four words ask for, and extensions of triples."""
    expand, _ = bit_set(within(triples, cuts, "bound"), ["h1", "h2", "h3"], rules)
    settle, _ = bit_set(within(triples, cuts, "cut.score"), ["h1", "h2", "h3"], rules)
    with rows_at_once(coded.sparkSession, CODES_AT_ONCE):
        fours = stage(count_phrases(coded, 4, rules, able, expand, settle), "fours")
    asked = stage(within(known_fours(fours, pairs, triples).filter("missing"), cuts, "cut.score").select(
        F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("h4").alias("h3")).distinct(), "asked")
    requested, rows = bit_set(asked, ["h1", "h2", "h3"], rules)
    if not rows:
        return None, fours
    with rows_at_once(coded.sparkSession, CODES_AT_ONCE):
        found = stage(count_phrases(coded, 3, rules, able, exactly=requested), "found")
    return stage(known_triples(found.join(asked, ["h1", "h2", "h3"], "left_semi"), pairs), "triples"), fours


def ranked(survivors: DataFrame, vocabulary: DataFrame, totals: DataFrame, rules: Rules) -> DataFrame:
    """The first ``top`` of each language, with their texts. What cannot be among them by
    score goes before words are looked up."""
    keys = ["lang", "h", "a", "l", "r", "score"]
    lowest = top_per_group(survivors, ["lang"], [F.desc("score"), F.desc("a")], rules.top, F.col("h")).groupBy(
        "lang").agg(F.min("score").alias("lowest"))
    able = survivors.join(lowest, "lang").filter(F.col("score") >= F.col("lowest"))
    spelled = able.select(*keys, F.posexplode("h").alias("at", "one")).join(
        vocabulary.select(F.col("h").alias("one"), "word"), "one").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda w: w["word"].cast("string")), " ")
    named = spelled.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = top_per_group(named, ["lang"], order, rules.top, F.col("phrase"), "rank")
    return top.join(totals, "lang").select(
        F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        "n", "score")
