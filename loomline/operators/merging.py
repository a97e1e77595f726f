"""Building, sizing, versioning and fusing templates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomline.functions import tokens as T
from loomline.operators.components import connected_components
from loomline.operators.ranking import top_per_group
from loomline.session import drop_shuffles, release, stage

PART_ROWS = 1 << 14  # rows of a group that meet its one row in one place


def match_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], *more: Column) -> DataFrame:
    """Inner join on the groups, a null group with a null group."""
    named = right.withColumnsRenamed({g: f"_of_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
    return left.join(named, reduce(Column.__and__, [*same, *more])).drop(*[f"_of_{g}" for g in groups])


def deal_groups(rows: DataFrame, one: DataFrame, groups: Sequence[str], by: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``one``, which has a row for each group, with the ``_part`` they meet by.

    Groups of more than ``PART_ROWS`` rows are dealt to parts of about that size, and their one
    row goes to each part. Joined on the groups alone, the rows of a few large groups would be
    read by as few tasks: the planner sees a few filled partitions, and divides a side that it
    need not shuffle into no more. The table of large groups is written and short.
    """
    named = {g: f"_of_{g}" for g in groups}
    large = stage(rows.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
                  .filter("_parts > 1").withColumnsRenamed(named), "large")
    same = [F.col(g).eqNullSafe(F.col(of)) for g, of in named.items()]
    parts = F.coalesce("_parts", F.lit(1))
    dealt = F.pmod(F.xxhash64(F.spark_partition_id(), by), parts).cast("int")
    return (rows.join(large, same, "left").withColumn("_part", dealt).drop("_parts", *named.values()),
            one.join(large, same, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
            .drop("_parts", *named.values()))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def agreement(first: Column, other: Column) -> Column:
    """Where a sequence agrees with the first of its group: ``(word, bits)``, a bit for each
    of 64 positions. Positions beyond the end of ``other`` agree."""
    flags = F.zip_with(first, other, lambda a, b: F.coalesce(a == b, F.lit(True)).cast("long"))

    def word(flags: Column, i: Column) -> Column:
        bits = F.aggregate(F.reverse(F.slice(flags, i * 64 + 1, F.lit(64))), F.lit(0).cast("long"),
                           lambda made, flag: F.shiftleft(made, 1).bitwiseOR(flag))
        return F.struct(i.alias("word"), bits.alias("bits"))

    return once(flags, lambda f: F.transform(
        F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(f) - 1, 6), F.lit(0))), lambda i: word(f, i)))


def keep_agreed(first: Column, words: Column, wildcard: Column) -> Column:
    """``first`` with the wildcard where a bit of ``words``, in order, is not set."""
    def kept(token: Column, i: Column) -> Column:
        bits = F.get(words, F.shiftright(i, 6))["bits"]
        return F.when(F.getbit(bits, i.bitwiseAND(63)) == 1, token).otherwise(wildcard)

    return F.transform(first, kept)


def agreed_words(first: DataFrame, others: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups, _words)`` of the groups that have ``others(groups, _packed)``: where all of
    them agree with ``first(groups, _first)``. Only bits go through the fold, one row for 64
    positions, combined before the shuffle. Large groups meet their first in parts."""
    met = match_groups(*deal_groups(others, first, groups, "_packed"), [*groups, "_part"])
    words = met.select(*groups, F.inline(agreement(T.unpack_tokens(F.col("_first")), T.unpack_tokens(F.col("_packed")))))
    return words.groupBy(*groups, "word").agg(F.bit_and("bits").alias("bits")).groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("_words"))


def merge_group(members: DataFrame, group_cols: Sequence[str], wildcard: str = "<*>",
                tokens_col: str = "tokens") -> DataFrame:
    """Fold all token sequences of a group: a position keeps its token if all
    members agree, else it is the wildcard.

    One of the longest members of each group is found by number; it is the result
    of a group of one, and the others are compared with it. Tokens are shuffled as
    whole texts, once to find the first members and once to meet them; a group of
    any size is spread by the planner, since the first members are a written table.
    A group of empty lines keeps its row.
    """
    groups = list(group_cols)
    tokens = F.coalesce(tokens_col, F.array().cast("array<string>"))
    number = F.shiftleft(F.size(tokens).cast("long"), 40) + F.xxhash64(tokens).bitwiseAND((1 << 40) - 1)
    numbered = members.select(*groups, number.alias("_number"), T.pack_tokens(tokens).alias("_packed"))
    heads = numbered.groupBy(*groups).agg(F.max("_number").alias("_first_number"), F.count(F.lit(1)).alias("_members"))
    found = match_groups(numbered, heads, groups, F.col("_number") == F.col("_first_number"))
    alone = found.filter("_members = 1").select(*groups, T.unpack_tokens(F.col("_packed")).alias("tokens"))
    first = stage(found.filter("_members > 1").groupBy(*groups).agg(F.min("_packed").alias("_first")), "first")
    agreed = agreed_words(first, numbered.select(*groups, "_packed"), groups)
    folded = match_groups(first, agreed, groups).select(*groups, keep_agreed(
        T.unpack_tokens(F.col("_first")), F.col("_words"), F.lit(wildcard)).alias("tokens"))
    return alone.unionByName(folded).withColumnRenamed("tokens", tokens_col)


def template_sizes(templates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Templates, lines covered and singletons per key."""
    return templates.groupBy(*keys).agg(
        F.count("*").alias("templates"),
        F.sum("size").alias("lines"),
        F.count_if(F.col("size") == 1).alias("singletons"),
        F.max("size").alias("largest"))


def top_templates(templates: DataFrame, k: int, id_col: str = "template_id") -> DataFrame:
    """The ``k`` largest templates; ties by id."""
    return templates.orderBy(F.desc("size"), F.asc(id_col)).limit(k)


def change_log(before: DataFrame, after: DataFrame, id_col: str = "template_id") -> DataFrame:
    """Compare two catalog versions: created / changed / none / removed."""
    old = before.select(id_col, F.col("tokens").alias("_old"), F.col("size").alias("_old_size"))
    new = after.select(id_col, F.col("tokens").alias("_new"), F.col("size").alias("_new_size"))
    change = (F.when(F.col("_old").isNull(), "created")
              .when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "changed")
              .otherwise("none"))
    joined = old.join(new, id_col, "full_outer")
    return joined.select(
        id_col, change.alias("change_type"),
        T.token_text(F.coalesce("_new", "_old")).alias("template_mined"),
        F.coalesce("_old_size", F.lit(0)).alias("size_before"),
        F.coalesce("_new_size", F.lit(0)).alias("size_after"))


def line_results(lines: DataFrame, templates: DataFrame, keys: Sequence[str] = (),
                 change: DataFrame | None = None) -> DataFrame:
    """One result row per line.

    ``lines(line_id, template_id)`` usually comes from ``plans.mining``;
    ``change(template_id, change_type)`` from ``change_log``. The total is a
    scalar subquery, counted once.
    """
    total = templates.select(F.count("*").alias("total")).scalar()
    info = templates.select(*keys, "template_id", F.col("size").alias("cluster_size"),
                            T.token_text(F.col("tokens")).alias("template_mined"))
    out = lines.join(info, [*keys, "template_id"])
    if change is not None:
        out = out.join(change.select("template_id", "change_type"), "template_id", "left")
    else:
        out = out.withColumn("change_type", F.lit("none"))
    return out.select(*keys, "line_id", "change_type", F.col("template_id").alias("cluster_id"),
                      "cluster_size", "template_mined", total.alias("total_cluster_count"))


def retain_templates(templates: DataFrame, max_clusters: int | None,
                     keys: Sequence[str] = (), id_col: str = "template_id") -> DataFrame:
    """Keep the ``max_clusters`` most recently used templates of each key."""
    if max_clusters is None:
        return templates
    order = [F.desc("last_id"), F.asc(id_col)]
    if not keys:
        return templates.orderBy(*order).limit(max_clusters)
    return top_per_group(templates, keys, order, max_clusters, F.col(id_col))


def fuse_labels(links: DataFrame, raw_col: str = "shape_id", template_col: str = "template_id"
                ) -> DataFrame:
    """Connected components of ``links(raw, template)``: ``(template, fused_id)``.

    Templates are numbered once, and all rounds run on pairs of numbers: the smallest
    and the largest number around each raw shape, and where a raw shape has more links,
    the smallest and each other one. The result names a component by its smallest
    template. A raw shape or template with a large share of the links is only ever an
    aggregate, or one row of the small side of a join.
    """
    pairs = links.select(F.col(raw_col).alias("_raw"), F.col(template_col).alias("_t")).filter(
        "_raw IS NOT NULL AND _t IS NOT NULL")
    numbers = stage(pairs.select("_t").distinct().withColumn("_node", F.monotonically_increasing_id()), "numbers")
    around = stage(pairs.join(numbers, "_t").select("_raw", "_node"), "around")
    ends = stage(around.groupBy("_raw").agg(
        F.min("_node").alias("a"), F.max("_node").alias("b"), F.count(F.lit(1)).alias("_links")).filter("a < b"), "ends")
    others = around.join(ends.filter("_links > 2").select("_raw", "a"), "_raw").select("a", F.col("_node").alias("b"))
    components = connected_components(ends.select("a", "b").unionByName(others))
    labelled = stage(numbers.join(components.withColumnRenamed("node", "_node"), "_node", "left").select(
        "_t", F.coalesce("component", "_node").alias("_component")), "labelled")
    release(numbers, around, ends, components)
    names = labelled.groupBy("_component").agg(F.min("_t").alias("fused_id"))
    return labelled.join(names, "_component").select(F.col("_t").alias(template_col), "fused_id")


def fuse_templates(links: DataFrame, templates: DataFrame, wildcard: str = "<*>") -> DataFrame:
    """Templates that share a raw shape become one; their tokens are folded.

    ``links(shape_id, template_id, cnt)`` carries each shape's lines once per
    source; ``size`` of the result adds every link's lines.
    """
    labels = stage(fuse_labels(links), "fused")
    lines = links.groupBy("template_id").agg(F.sum("cnt").alias("lines"))
    sizes = lines.join(labels, "template_id").groupBy("fused_id").agg(
        F.sum("lines").alias("size"), F.count(F.lit(1)).alias("members"))
    sized = stage(labels.join(sizes, "fused_id"), "sized")
    release(labels)
    # Tokens meet their label once, as one text, and take size and members along.
    packed = templates.select("template_id", T.pack_tokens(F.col("tokens")).alias("_packed"))
    labelled = stage(packed.join(sized, "template_id").select(
        "fused_id", "size", "members", T.unpack_tokens(F.col("_packed")).alias("tokens")), "labelled")
    release(sized)
    drop_shuffles(labelled.sparkSession)
    tokens = merge_group(labelled, ["fused_id", "size", "members"], wildcard)
    return tokens.select("fused_id", F.size("tokens").alias("n"), "tokens", "size", "members")
