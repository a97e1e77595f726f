"""Mixing sources to target weights (5): a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of the document id. Its blocks are put
in a random order, once for every pass over the source, and the first of them
that hold its target of words are its *slots*; of the block at the target only
the part up to the target is taken. The slots of all sources are then dealt to
the output shards by a binary tree: a node gives half of its slots to its left
child, how many of each source is one draw from the multivariate hypergeometric
law, and the quotas stay exact because the right child gets the rest. A leaf
owns the slots between two offsets of each source's order, so the shards' blocks
are disjoint and no draw is repeated. Inside a shard rows are ordered by a hash.

Only DataFrame functions. Documents are read for sums by block, and once more
to attach their slots: the block table has ``blocks`` rows a source, whatever
the number of documents, so no task holds a source. A hot source is spread over
its blocks. Windows run over one row per source or per block, never documents.

Defined results: null texts have size 0; a null source is a source of its own,
the last; an empty table gives an empty mix; documents of size 0 go with their
block; rows that repeat a doc_id share a hash and are taken alike; reruns agree,
since all that is random is a hash of the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomline.llm.common import let, words_of
from loomline.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
NO_LIMIT = (1 << 63) - 1


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``(source, words)``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. The level at
    which all get weight times level, but no more than ``most`` times their
    words, is what resharing the excess ends at; it is found by ordering the
    sources by the level at which they are full.
    """
    one = F.lit(1)
    by_name = W.partitionBy(one).orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    full = (totals.withColumn("weight", weight)
            .withColumn("most", F.col("words") * F.lit(float(most)))
            .withColumn("full_at", F.col("most") / F.col("weight")))
    by_level = W.partitionBy(one).orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(one)
    level = ((F.sum("words").over(everything) * F.lit(float(share))
              - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    levelled = full.withColumn("level", level).withColumn("level", F.max(
        F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    return levelled.select("source", "words", F.coalesce(
        F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among ``good``: inversion
    of the law between twelve standard deviations of the mean, weights by their ratios."""
    def of(a: Column) -> Column:
        n, k, m = a["n"], a["k"], a["m"]
        mean = m * k / F.greatest(n, F.lit(1.0))
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (n - k) / F.greatest(n, F.lit(1.0))
                    * (n - m) / F.greatest(n - 1, F.lit(1.0))))
        lo = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - 12 * sd - 2))
        hi = F.least(k, m, F.ceil(mean + 12 * sd + 2))
        return let(F.struct(n.alias("n"), k.alias("k"), m.alias("m"), lo.alias("lo"),
                            F.greatest(lo, hi).alias("hi"), a["u"].alias("u")), invert)

    def invert(a: Column) -> Column:
        ratio = lambda x: ((a["k"] - x) * (a["m"] - x)
                           / F.greatest((x + 1) * (a["n"] - a["k"] - a["m"] + x + 1), F.lit(1e-9)))
        steps = F.sequence(a["lo"].cast("long"), a["hi"].cast("long"))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"),
                         F.array().cast("array<double>").alias("up_to"))
        summed = F.aggregate(
            steps, start,
            lambda acc, x: F.struct(
                (acc["w"] * ratio(x.cast("double"))).alias("w"),
                (acc["sum"] + acc["w"]).alias("sum"),
                F.concat(acc["up_to"], F.array(acc["sum"] + acc["w"])).alias("up_to")))
        return let(summed, lambda s: (a["lo"] + F.size(F.filter(
            s["up_to"], lambda c: c <= a["u"] * s["sum"]))).cast("long"))

    return let(F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"),
                        drawn.cast("double").alias("m"), u.alias("u")), of)


QUOTAS = "array<struct<rank:int,start:bigint,quota:bigint>>"


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(rank, quota)`` of the sources to ``(shard, rank, start, quota)`` of the leaves."""
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.lit(0).cast("long").alias("start"), F.col("quota").cast("long").alias("quota"))))
        .cast(QUOTAS).alias("quotas")).withColumn("shard", F.lit(0).cast("long"))
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["quota"])
        start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("draw"),
                         F.array().cast(QUOTAS).alias("left"), F.array().cast(QUOTAS).alias("right"))

        def step(acc: Column, q: Column) -> Column:
            drawn = hypergeometric(acc["rest"], q["quota"], acc["draw"], uniform(
                F.lit(seed), F.lit(level), F.col("shard"), q["rank"]))  # noqa: B023  (called at once)
            return let(drawn, lambda k: F.struct(
                (acc["rest"] - q["quota"]).alias("rest"), (acc["draw"] - k).alias("draw"),
                F.concat(acc["left"], F.array(F.struct(
                    q["rank"].alias("rank"), q["start"].alias("start"), k.alias("quota"))))
                .cast(QUOTAS).alias("left"),
                F.concat(acc["right"], F.array(F.struct(
                    q["rank"].alias("rank"), (q["start"] + k).alias("start"),
                    (q["quota"] - k).alias("quota")))).cast(QUOTAS).alias("right")))

        halves = F.aggregate("quotas", start, step, lambda acc: F.array(acc["left"], acc["right"]))
        tree = tree.select("shard", F.posexplode(halves).alias("side", "quotas")).select(
            (F.col("shard") * 2 + F.col("side")).alias("shard"), "quotas")
    return tree.select("shard", F.inline("quotas")).filter("quota > 0")


def plan_mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                 most: float = 2.0, seed: int = 17, blocks: int = 512,
                 shard_words: int = 1 << 22, text_col: str = "text", id_col: str = "doc_id",
                 source_col: str = "source") -> DataFrame:
    """``docs`` with ``size, source_size, target`` and ``copies``: an array of
    ``(shard, at)``, one element for each time that the mix takes the document."""
    made = {"size", "source_size", "target", "copies", "_key", "_block", "_sub", "_slots", "_s"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    size = F.size(words_of(F.col(text_col))).cast("long")
    source = F.col(source_col).cast("string")
    facts = stage(docs.select(source.alias("source"), key.alias("key"), size.alias("size")), "sizes")
    sums = facts.groupBy("source").agg(F.sum("size").alias("words"))
    by_name = W.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    targets = stage(source_targets(sums, weights, share, most).withColumn(
        "rank", F.row_number().over(by_name)), "targets")
    asked = targets.agg(F.sum("target")).first()[0] or 0.0
    depth = 0
    while asked > shard_words << depth:
        depth += 1
    blocks = max(blocks, 4 << depth)
    block, sub = _places(F.col("key"), blocks)

    # Slots: every block once a full pass, then the first blocks of a last pass.
    sized = facts.select("source", "size", block.alias("block"), sub.alias("sub"))
    joined = lambda df: df.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    table = joined(sized.groupBy("source", "block").agg(F.sum("size").alias("in_block")))
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    table = table.withColumn("passes", passes.cast("int"))
    table = table.withColumn("rest", F.col("target") - F.col("passes") * F.col("words")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    shuffled = W.partitionBy("rank", "turn").orderBy(
        F.xxhash64(F.lit(seed), "rank", "turn", "block"), "block")
    up_to = F.sum("in_block").over(shuffled.rowsBetween(W.unboundedPreceding, 0))
    table = table.withColumn("up_to", up_to).withColumn("before", up_to - F.col("in_block"))
    last = F.col("turn") == F.col("passes")
    table = table.filter(~last | (F.col("before") < F.col("rest")))
    cut = last & (F.col("up_to") > F.col("rest"))
    table = stage(table.select("source", "rank", "turn", "block", cut.alias("cut"),
                               (F.col("rest") - F.col("before")).alias("left")), "slots")

    # Of a block that is cut, parts in hash order as far as comes nearest to the target.
    part_key = F.xxhash64(F.lit(seed), F.lit("part"), "rank", "sub")
    at_cut = table.filter("cut").select(F.col("source").alias("_s"), "rank", "block", "left")
    parts = (sized.join(at_cut, F.col("source").eqNullSafe(F.col("_s"))
                        & (sized["block"] == at_cut["block"]))
             .groupBy("rank", "left", part_key.alias("part")).agg(F.sum("size").alias("in_part")))
    in_order = W.partitionBy("rank").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    limits = (parts.withColumn("up_to", F.sum("in_part").over(in_order))
              .filter(F.col("up_to") - F.col("in_part") / 2 <= F.col("left"))
              .groupBy("rank").agg(F.max("part").alias("limit")))
    slots = (table.join(limits, "rank", "left")
             .withColumn("limit", F.when(F.col("cut"), F.coalesce("limit", F.lit(-NO_LIMIT)))
                         .otherwise(F.lit(NO_LIMIT)))
             .withColumn("slot", F.row_number().over(W.partitionBy("rank").orderBy(
                 "turn", F.xxhash64(F.lit(seed), "rank", "turn", "block"), "block")) - 1))
    slots = stage(slots.select("source", "rank", "turn", "block", "limit",
                               F.col("slot").cast("long").alias("slot")), "slots")

    quotas = slots.groupBy("rank").agg(F.count("*").alias("quota"))
    leaves = split_quotas(quotas, depth, seed)
    dealt = leaves.select("shard", "rank", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("quota") - 1)).alias("slot"))
    by_block = stage(
        slots.join(dealt, ["rank", "slot"]).groupBy("source", "rank", "block").agg(
            F.array_sort(F.collect_list(F.struct("turn", "shard", "limit"))).alias("_slots")),
        "blocks")

    keyed = docs.withColumn("_key", key).withColumn("size", size)
    block, sub = _places(F.col("_key"), blocks)
    keyed = keyed.withColumn("_block", block).withColumn("_sub", sub)
    found = by_block.select(F.col("source").alias("_s"), F.col("block").alias("_b"),
                            F.col("rank").alias("_r"), "_slots")
    out = keyed.join(found, source.eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    out = out.drop("_s", "_b", "_block")
    known = targets.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target")
    out = out.join(known, source.eqNullSafe(F.col("_s")), "left").drop("_s")
    mine = F.xxhash64(F.lit(seed), F.lit("part"), F.col("_r"), F.col("_sub"))
    taken = F.filter("_slots", lambda s: (s["limit"] == F.lit(NO_LIMIT)) | (mine <= s["limit"]))
    copies = F.transform(taken, lambda s: F.struct(
        s["shard"].alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("at"), s["shard"], s["turn"], F.col("_key")).alias("at")))
    return out.withColumn("copies", F.coalesce(copies, F.array().cast(
        "array<struct<shard:bigint,at:bigint>>"))).drop("_key", "_sub", "_r", "_slots")


def _places(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block and part of a document in its block, from its hash."""
    return (F.pmod(key, F.lit(blocks)).cast("int"),
            F.pmod(F.floor(key / F.lit(blocks)), F.lit(1 << 20)).cast("int"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, with its ``shard``, dealt
    to partitions by shard and in a random order inside each."""
    carried = [c for c in docs.columns if c.lower() not in ("shard", "_copy", "_at")]
    planned = plan_mixture(docs.select(*[F.col(f"`{c}`") for c in carried]), **settings)
    rows = planned.select(*[F.col(f"`{c}`") for c in carried], F.explode("copies").alias("_copy"))
    rows = rows.select(*[F.col(f"`{c}`") for c in carried], F.col("_copy.shard").alias("shard"),
                       F.col("_copy.at").alias("_at"))
    return rows.repartition("shard").sortWithinPartitions("shard", "_at").drop("_at")
