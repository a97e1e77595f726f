"""Top rows per group without one task seeing a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

# Up to this limit the planner ranks on the map side by itself.
PLANNER_LIMIT = 1000


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  spread: Column, rank_col: str | None = None, pieces: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    Small limits are cut by the planner before the shuffle. For larger ones a
    group is first cut in ``pieces`` parts by a hash of ``spread`` (a column
    that differs inside a group), each limited to ``k``.
    """
    name = rank_col or "_rank"
    if k > PLANNER_LIMIT:
        parts = W.partitionBy(*groups, "_piece").orderBy(*order)
        df = (df.withColumn("_piece", F.pmod(F.xxhash64(spread), F.lit(pieces)))
              .withColumn("_in_piece", F.row_number().over(parts))
              .filter(F.col("_in_piece") <= k).drop("_piece", "_in_piece"))
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    out = ranked.filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)
