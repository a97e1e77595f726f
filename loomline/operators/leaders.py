"""Leaders of crowded blocks by a candidate join and parallel rounds.

A member is a leader if no leader ranked above it is similar enough. That set is the
lexicographically first independent set of the graph of similar members, so it can be
found in parallel: a member is settled as soon as all its better neighbours are.

*Candidates.* Two members of one length agree in ``need`` positions or more if they are
similar. With the marks (position and literal) of each member in one order, rare ones
first, two similar members share one among their first ``m - need + 1`` marks, ``m`` the
number of literals. These marks are the index; only members that meet there are compared.

*Rounds.* In each round the lists of the index are cut to their best ranked open members,
the front, four times as many each round. Similar pairs inside the fronts are edges.
A member that is in the front of all its lists knows all its better neighbours: it leads
once none of them is left, and falls to any of them that leads. Then the new leaders are
compared with the open members beyond the fronts. A long list of like members is never
paired with itself, as its first leader takes the others out.

Rows of all tables but ``members`` are pairs of numbers; tokens are looked up for pairs
that are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from loomline.operators.ranking import top_per_group
from loomline.session import release, stage

GROWTH = 4

Compare = Callable[[Column, Column, Column], Column]


@dataclass
class Rounds:
    """What the last search did: ``fronts`` widened, and parallel ``steps`` in all."""

    fronts: int = 0
    steps: int = 0


def least_common(n: Column, th: Column) -> Column:
    """The fewest equal positions of ``n`` whose share reaches ``th``."""
    size = n.cast("double")
    guess = F.ceil(th * size).cast("int")
    return F.greatest(F.lit(1), F.when((guess - 1) / size >= th, guess - 1).when(guess / size < th, guess + 1)
                      .otherwise(guess))


def placed_members(members: DataFrame) -> DataFrame:
    """Members with ``place``, a number that rises with the rank; written."""
    order = [F.desc("known"), F.desc("cnt"), F.asc("first_id"), F.asc("node_id")]
    return stage(members.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("place", F.monotonically_increasing_id()), "placed")


def mark_index(members: DataFrame, th: Column, wildcard: str) -> DataFrame:
    """``(place, mark)``: the marks of each member that a similar one must meet it at."""
    literals = F.filter(F.transform("tokens", lambda t, i: F.when(t != wildcard, F.xxhash64("block", i, t))),
                        lambda m: m.isNotNull())
    marked = members.select("place", least_common(F.col("n"), th).alias("need"), literals.alias("marks")).filter(
        F.size("marks") >= F.col("need"))
    listed = stage(marked.select("place", (F.size("marks") - F.col("need") + 1).alias("room"),
                                 F.explode("marks").alias("mark")), "marks")
    often = listed.groupBy("mark").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = listed.join(often, "mark", "left").groupBy("place", "room").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1).cast("long")).alias("df"), "mark"))).alias("m"))
    index = stage(known.select("place", F.explode(F.slice("m", F.lit(1), F.col("room"))).alias("m"))
                  .filter("m.df > 1").select("place", "m.mark"), "index")
    release(listed)
    return index


def similar_pairs(pairs: DataFrame, members: DataFrame, compare: Compare, th: Column) -> DataFrame:
    """``(a, b, sim)`` of the pairs whose first is similar enough to the second."""
    shown = F.struct(*[c for c in members.columns if c not in ("place", "n", "block")]).alias("row")
    left = members.select(F.col("place").alias("a"), "n", shown.alias("row_a"))
    right = members.select(F.col("place").alias("b"), shown.alias("row_b"))
    compared = pairs.join(left, "a").join(right, "b").withColumn(
        "sim", compare(F.col("row_a"), F.col("row_b"), F.col("n")))
    return compared.filter(F.col("sim") >= th).select("a", "b", "sim", F.col("row_a.params").alias("params"))


def candidates(leaders: DataFrame, others: DataFrame, below_only: bool) -> DataFrame:
    """Pairs ``(a, b)`` of a leader and another member that meet in the index."""
    met = leaders.select(F.col("place").alias("a"), "mark").join(others.select(F.col("place").alias("b"), "mark"), "mark")
    return met.filter(F.col("a") < F.col("b") if below_only else F.col("a") != F.col("b")).select("a", "b").distinct()


def find_leaders(members: DataFrame, index: DataFrame, open_: DataFrame, compare: Compare, th: Column, front: int,
                 rounds: Rounds) -> DataFrame:
    """``(place)`` of the leaders among the open members ``open_(place)``."""
    open_ = stage(open_, "open")
    leaders: DataFrame | None = None
    while True:
        rounds.fronts += 1
        listed = stage(index.join(open_, "place"), "open_index")
        fronts = stage(top_per_group(listed, ["mark"], [F.asc("place")], front, F.col("place")), "fronts")
        waiting = listed.join(fronts, ["place", "mark"], "left_anti").select("place").distinct()
        pairs = fronts.select(F.col("place").alias("a"), "mark").join(
            fronts.select(F.col("place").alias("b"), "mark"), "mark").filter("a < b").select("a", "b").distinct()
        edges = stage(similar_pairs(pairs, members, compare, th).select("a", "b"), "edges")
        undecided = stage(open_.join(waiting.withColumn("waits", F.lit(True)), "place", "left")
                          .select("place", F.coalesce("waits", F.lit(False)).alias("waits")), "undecided")
        release(fronts)
        fresh, undecided = settle(undecided, edges, rounds)
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
        met = candidates(index.join(fresh, "place"), listed.join(undecided.select("place"), "place", "left_semi"), True)
        fallen = similar_pairs(met, members, compare, th).select(F.col("b").alias("place")).distinct()
        left = Observation()
        rest = stage(undecided.select("place").join(fallen, "place", "left_anti").observe(
            left, F.count(F.lit(1)).alias("rows")), "open")
        release(open_, listed, undecided)
        open_, front = rest, front * GROWTH
        if not left.get["rows"]:
            release(open_)
            return leaders


def settle(undecided: DataFrame, edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """New leaders, and what stays undecided, ``(place, waits)``. A step takes all members
    that have no better neighbour left, and what is similar to them goes."""
    found: DataFrame | None = None
    while True:
        rounds.steps += 1
        count = Observation()
        fresh = stage(undecided.filter("NOT waits").join(
            edges.select(F.col("b").alias("place")).distinct(), "place", "left_anti").select("place").observe(
            count, F.count(F.lit(1)).alias("rows")), "leaders")
        found = fresh if found is None else found.unionByName(fresh)
        if not count.get["rows"]:
            release(edges)
            return found, undecided
        gone = stage(edges.join(fresh.withColumnRenamed("place", "a"), "a", "left_semi").select(
            F.col("b").alias("place")).distinct(), "gone")
        decided = fresh.unionByName(gone)
        left = stage(undecided.join(decided, "place", "left_anti"), "undecided")
        rest = stage(edges.join(decided.withColumnRenamed("place", "a"), "a", "left_anti").join(
            gone.withColumnRenamed("place", "b"), "b", "left_anti"), "edges")
        release(undecided, edges, gone)
        undecided, edges = left, rest


def nearest_leaders(members: DataFrame, index: DataFrame, leaders: DataFrame, compare: Compare, th: Column
                    ) -> DataFrame:
    """``(place, sim, params, leader)``: the best leader of each member that has one."""
    leads = stage(leaders.distinct(), "leaders")
    met = candidates(index.join(leads, "place"), index.join(leads, "place", "left_anti"), False)
    scored = similar_pairs(met, members, compare, th)
    best = F.max(F.struct("sim", "params", (-F.col("a")).alias("rank"))).alias("best")
    own = leads.select("place", F.lit(2.0).alias("sim"), F.lit(0).alias("params"), F.col("place").alias("leader"))
    return scored.groupBy(F.col("b").alias("place")).agg(best).select(
        "place", "best.sim", "best.params", (-F.col("best.rank")).alias("leader")).unionByName(own)
