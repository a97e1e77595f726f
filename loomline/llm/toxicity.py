"""Toxicity (8): votes of the nearest labelled examples by exact TF-IDF cosine.

Fitting takes a bounded sample of labelled rows (``max_examples``, those of least
hash). The vocabulary is the words, and the beginnings of words, that are more
frequent under label 1, beyond chance (log-likelihood ratio), at most
``max_features`` of them; so the cosine is taken over what speaks for toxicity,
and the rest of a text, however long, does not blur it. Examples with the
same vector are one example with counts.

The index is an inverted index in blocks of examples with the largest weight of
each term in each block. A query sums these maxima to a bound for each block and
evaluates blocks in falling order of their bounds until no bound reaches the
k-th best cosine: the neighbours are exact. Their votes are weighted by distance,
smoothed towards the base rate and mapped by isotonic regression fitted on the
examples left out one by one, so scores are calibrated; the neighbours are the
evidence. Texts without a vocabulary term share the rate of such examples.

Scoring is a map over the rows of whole texts; the model that it needs has a
bounded size. Defined results: null and empty texts are texts without terms;
without any labelled row of one of the classes all scores are the base rate (0 if
there is none); repeated rows score alike; null labels are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7)
BLOCK = 64
TIE = 1e-12
NEAR = 0.05  # distance at which a vote counts half of that of an equal vector


def terms_of_word(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def without_nested(terms: list[str]) -> list[int]:
    """Places of the terms that do not continue an earlier one: what is left of a word
    says more than the beginnings that were chosen before it."""
    taken: set[str] = set()
    out = []
    for i, term in enumerate(terms):
        own = set(terms_of_word(term.rstrip("*"))) | {term}
        if not own & taken:
            out.append(i)
            taken.add(term)
    return out


@dataclass
class Example:
    vector: tuple[tuple[int, float], ...]
    toxic: int
    clean: int
    doc_id: int | None


@dataclass
class Model:
    """Vocabulary, block-max index and calibration."""

    features: dict[str, int]
    idf: list[float]
    examples: list[Example]
    k: int
    base: float
    steps: tuple[list[float], list[float]] = field(default=((), ()))

    def __post_init__(self) -> None:
        """Postings by term, in blocks of examples: (examples, weights), and for each
        block that a term is in, its largest weight there."""
        lists: list[list[tuple[int, float]]] = [[] for _ in self.idf]
        for i, example in enumerate(self.examples):
            for term, weight in example.vector:
                lists[term].append((i, weight))
        self.postings, self.maxima = [], []
        for rows in lists:
            ids = np.array([i for i, _ in rows], dtype=np.int64)
            weights = np.array([w for _, w in rows])
            blocks, first = np.unique(ids // BLOCK, return_index=True)
            most = np.maximum.reduceat(weights, first) if len(ids) else weights
            self.postings.append((ids, weights))
            self.maxima.append((blocks, most))
        self.rows = np.array([e.toxic + e.clean for e in self.examples], dtype=np.int64)
        self.memory: dict[tuple, tuple] = {}

    def vector(self, counts: dict[int, int]) -> tuple[tuple[int, float], ...]:
        weights = {t: (1.0 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return tuple(sorted((t, w / norm) for t, w in weights.items()))

    def nearest(self, vector: tuple[tuple[int, float], ...], left_out: int | None = None
                ) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest labelled rows and all ties with the
        last, by falling cosine; exact. ``left_out``: one row of this example is ignored."""
        blocks = -(-len(self.examples) // BLOCK)
        bounds = np.zeros(blocks)
        for term, weight in vector:
            at, most = self.maxima[term]
            bounds[at] += weight * most
        order = np.argsort(-bounds, kind="stable")
        rows = self.rows
        if left_out is not None:
            rows = rows.copy()
            rows[left_out] -= 1
        found = np.empty(0, dtype=np.int64)
        cosines = np.zeros(len(self.examples))
        least, at, step = -1.0, 0, 4
        while at < blocks and bounds[order[at]] > 0 and bounds[order[at]] >= least - TIE:
            wanted = np.zeros(blocks, dtype=bool)
            wanted[order[at:at + step]] = True
            at, step = at + step, step * 4
            for term, weight in vector:
                ids, weights = self.postings[term]
                inside = wanted[ids // BLOCK]
                cosines[ids[inside]] += weight * weights[inside]
            fresh = np.flatnonzero(np.repeat(wanted, BLOCK)[:len(cosines)] & (cosines > 0) & (rows > 0))
            found = np.r_[found, fresh[cosines[fresh] >= least - TIE]]
            found = found[np.lexsort((found, -cosines[found]))]
            reached = np.searchsorted(np.cumsum(rows[found]), self.k)
            if reached < len(found):
                least = cosines[found[reached]]
                found = found[cosines[found] >= least - TIE]
        return [(float(cosines[i]), int(i)) for i in found]

    def raw(self, vector: tuple[tuple[int, float], ...], left_out: tuple[int, int] | None = None
            ) -> tuple[float, list[tuple[float, int]]]:
        """Distance-weighted share of toxic votes; ``left_out``: (example, its label)."""
        if not vector:
            zero = next((i for i, e in enumerate(self.examples) if not e.vector), None)
            near = [] if zero is None else [(1.0, zero)]
        else:
            near = self.nearest(vector, left_out[0] if left_out else None)
        votes, toxic = 1.0, self.base
        for cosine, i in near:
            weight = NEAR / (NEAR + max(0.0, 1.0 - cosine))
            e = self.examples[i]
            pos, neg = e.toxic, e.clean
            if left_out and i == left_out[0]:
                pos, neg = pos - left_out[1], neg - (1 - left_out[1])
            votes += weight * (pos + neg)
            toxic += weight * pos
        return toxic / votes, near

    def calibrate(self) -> None:
        """Isotonic regression of labels on left-out scores (pool adjacent violators)."""
        seen: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for i, e in enumerate(self.examples):
            for label, n in ((1, e.toxic), (0, e.clean)):
                if n:
                    at = seen[round(self.raw(e.vector, (i, label))[0], 9)]
                    at[0] += label * n
                    at[1] += n
        pools: list[list[float]] = []
        for score in sorted(seen):
            pools.append([score, *seen[score]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, pos, n = pools.pop()
                pools[-1][1] += pos
                pools[-1][2] += n
        self.steps = ([p[0] for p in pools], [
            (p[1] + self.base) / (p[2] + 1.0) for p in pools])
        self.memory.clear()

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        key = tuple(sorted(counts.items()))
        if key not in self.memory:
            if len(self.memory) > 50_000:
                self.memory.clear()
            value, near = self.raw(self.vector(counts) if counts else ())
            starts, values = self.steps
            if starts:
                value = values[max(0, bisect_right(starts, value) - 1)]
            self.memory[key] = (value, near)
        return self.memory[key]


class TermCounter:
    """Counts of vocabulary terms in a text; remembers words met before."""

    def __init__(self, features: dict[str, int]) -> None:
        self.features = features
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> dict[int, int]:
        words = WORD.findall(text.lower())
        if len(self.known) > 500_000:
            self.known.clear()
        get = self.features.get
        for word in set(words).difference(self.known):
            self.known[word] = tuple(f for t in terms_of_word(word) if (f := get(t)) is not None)
        out: Counter[int] = Counter()
        for found in filter(None, map(self.known.__getitem__, words)):
            out.update(found)
        return out


def likelihood_ratio(a: float, b: float, n_a: float, n_b: float) -> float:
    """G squared of presence (a of n_a, b of n_b) against independence."""
    total, rows = 0.0, (a + b, n_a + n_b - a - b)
    for seen, row, column in ((a, rows[0], n_a), (b, rows[0], n_b), (n_a - a, rows[1], n_a),
                              (n_b - b, rows[1], n_b)):
        expected = row * column / (n_a + n_b)
        if seen > 0 and expected > 0:
            total += seen * math.log(seen / expected)
    return 2.0 * total


def fit(docs: DataFrame, labels: DataFrame, k: int = 25, max_examples: int = 20_000,
        max_features: int = 4096, least_ratio: float = 30.0, text_col: str = "text",
        id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on at most ``max_examples`` rows of ``labels(doc_id, toxic)``."""
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    ids = ids.filter("_id IS NOT NULL AND _y IN (0, 1)").orderBy(
        F.xxhash64("_id"), "_id", "_y").limit(max_examples)
    # The sample is bounded by max_examples ids, 16 bytes each: small enough to broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t")) \
        .join(F.broadcast(ids), "_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[label].update({t for w in set(WORD.findall((text or "").lower()))
                                    for t in terms_of_word(w)})
                seen[label][""] += 1
        names = [*seen[0], *(t for t in seen[1] if t not in seen[0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[0][t] for t in names], pa.int64()),
             pa.array([seen[1][t] for t in names], pa.int64())], ["term", "clean", "toxic"])

    counted = rows.mapInArrow(terms, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.filter("term = ''").first()
    n_clean, n_toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    base = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
    if not n_clean or not n_toxic:
        return Model({}, [], [], k, base)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / F.lit(float(n_toxic + n_clean))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(a, share * n_toxic) + part(b, share * n_clean)
                 + part(n_toxic - a, (1 - share) * n_toxic) + part(n_clean - b, (1 - share) * n_clean))
    chosen = counted.filter("term != ''").filter((share < 1) & (a * n_clean > b * n_toxic)).withColumn(
        "ratio", ratio).filter(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), "term").limit(max_features).collect()
    chosen = [chosen[i] for i in without_nested([r["term"] for r in chosen])]
    features = {r["term"]: i for i, r in enumerate(chosen)}
    n = n_clean + n_toxic
    idf = [math.log((1 + n) / (1 + r["clean"] + r["toxic"])) + 1.0 for r in chosen]

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(features)
        for batch in batches:
            keys = [",".join(f"{t}:{c}" for t, c in sorted(counter.counts(t_ or "").items()))
                    for t_ in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.string()), batch.column(2)], ["_id", "key", "_y"])

    found = rows.mapInArrow(examples, "_id long, key string, _y int").groupBy("key").agg(
        F.sum("_y").alias("toxic"), F.count("*").alias("rows"), F.min("_id").alias("doc_id"))
    model = Model(features, idf, [], k, base)
    examples_ = []
    for r in sorted(found.collect(), key=lambda r: r["key"]):  # at most max_examples rows
        counts = {int(t): int(c) for t, c in (x.split(":") for x in r["key"].split(",") if x)}
        vector = model.vector(counts) if counts else ()
        examples_.append(Example(vector, r["toxic"], r["rows"] - r["toxic"], r["doc_id"]))
    model = Model(features, idf, examples_, k, base)
    model.calibrate()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id",
          keep: int = 3) -> DataFrame:
    """``doc_id, score, predicted, evidence``: the nearest examples with cosine and share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ("doc_id long, score double, predicted int, "
              "evidence array<struct<doc_id:long,cosine:double,toxic:double>>")
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()),
                                        ("toxic", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counter = TermCounter(m.features)
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                value, near = m.score(counter.counts(text or ""))
                scores.append(value)
                evidence.append([
                    {"doc_id": e.doc_id, "cosine": c, "toxic": e.toxic / (e.toxic + e.clean)}
                    for c, i in near[:keep] for e in (m.examples[i],)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(evidence, evidence_type)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
