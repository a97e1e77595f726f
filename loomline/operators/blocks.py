"""Block keys: which shapes and templates may be compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomline.functions import tokens as T
from loomline.functions.tokens import SEP
from loomline.operators.ranking import top_per_group
from loomline.options import MinerOptions
from loomline.session import release, stage


def key_text(key: Column) -> Column:
    return F.concat_ws(SEP, key)


def block_by_length(shapes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shapes and lines per token count."""
    return shapes.groupBy(*keys, "n").agg(
        F.count("*").alias("shapes"), F.sum("cnt").alias("lines"))


def ids_for_length(shapes: DataFrame, n: int) -> DataFrame:
    """All shapes (or templates) with the given token count."""
    return shapes.filter(F.col("n") == n)


def with_prefix_key(shapes: DataFrame, options: MinerOptions, name: str = "prefix_key") -> DataFrame:
    return shapes.withColumn(name, T.prefix_key(
        F.col("tokens"), F.col("n"), options.depth, options.numeric_tokens, options.wildcard))


def with_suffix_key(shapes: DataFrame, options: MinerOptions, name: str = "suffix_key") -> DataFrame:
    return shapes.withColumn(name, T.suffix_key(
        F.col("tokens"), F.col("n"), options.depth, options.numeric_tokens, options.wildcard))


def cap_children(shapes: DataFrame, key_col: str, levels: int, options: MinerOptions,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Keep the ``max_children - 1`` most frequent tokens under each key prefix;
    the others become the wildcard, level by level.

    Works on the table of distinct keys. Only levels at which some prefix has
    too many children cost a pass, so depth alone costs nothing; the shapes are
    joined once, with the final keys. Counts are combined before the shuffle and
    the rank limit runs on both sides of it, so a prefix that holds most rows
    is no hot spot.
    """
    group = [*keys, "n"]
    paths = stage(shapes.groupBy(*group, F.col(key_col).alias("_key")).agg(F.sum("cnt").alias("_w"))
                  .withColumn("_path", F.slice("_key", 1, levels)), "paths")
    level, capped = 0, False
    while (level := _crowded_level(paths, group, level, options)) is not None:
        fresh = stage(_cap_level(paths, group, level, options), "paths")
        release(paths)
        paths, capped = fresh, True
    if not capped:
        return shapes.withColumn(key_col, F.slice(key_col, 1, levels))
    final = paths.select(*group, F.col("_key").alias(key_col), "_path")
    return (shapes.join(final, [*group, key_col], "left")
            .withColumn(key_col, F.coalesce("_path", F.slice(key_col, 1, levels))).drop("_path"))


def _crowded_level(paths: DataFrame, group: Sequence[str], after: int, options: MinerOptions
                   ) -> int | None:
    """The first level beyond ``after`` where a prefix has more children than kept."""
    start = F.struct(F.lit(0).cast("long").alias("above"),
                     F.array().cast("array<struct<above:bigint,token:string>>").alias("nodes"))
    nodes = F.aggregate(
        "_path", start,
        lambda s, t: F.struct(
            F.xxhash64(s["above"], t).alias("above"),
            F.concat(s["nodes"], F.array(F.struct(s["above"].alias("above"), t.alias("token"))))
            .alias("nodes")),
        lambda s: s["nodes"])
    placed = paths.select(*group, F.posexplode(nodes).alias("_level", "_node")).filter(
        (F.col("_level") >= after) & (F.col("_node.token") != options.wildcard))
    children = placed.select(*group, "_level", "_node.above", "_node.token").distinct()
    crowded = children.groupBy(*group, "_level", "above").agg(F.count("*").alias("_c")).filter(
        F.col("_c") >= options.max_children)
    found = crowded.agg(F.min("_level")).first()[0]
    return None if found is None else found + 1


def _cap_level(paths: DataFrame, group: Sequence[str], level: int, options: MinerOptions
               ) -> DataFrame:
    """``_path`` with the rare tokens of one level turned into the wildcard."""
    wildcard = F.lit(options.wildcard)
    above = paths.withColumn("_above", F.slice("_path", 1, level - 1)).withColumn(
        "_tok", F.try_element_at("_path", F.lit(level)))
    on = [*group, "_above", "_tok"]
    counted = (above.filter(F.col("_tok").isNotNull() & (F.col("_tok") != wildcard))
               .groupBy(*on).agg(F.sum("_w").alias("_cw")))
    order = [F.desc("_cw"), F.asc("_tok")]
    kept = (top_per_group(counted, [*group, "_above"], order, options.max_children - 1, F.col("_tok"))
            .select(*on, F.lit(True).alias("_keep")))
    replaced = F.concat("_above", F.array(wildcard), F.slice("_path", level + 1, 1 << 30))
    return above.join(kept, on, "left").withColumn("_path", F.when(
        F.col("_tok").isNull() | F.coalesce("_keep", F.lit(False)), F.col("_path"))
        .otherwise(replaced)).drop("_above", "_tok", "_keep")


def template_keys(templates: DataFrame, options: MinerOptions,
                  id_col: str = "template_id") -> DataFrame:
    """Every block key a template can be reached by, with its kind.

    The literal key, and the key whose changing positions (wildcards, tokens
    with digits) are the wildcard. Rows: ``(id, n, key, kind)``.
    """
    n, tokens = F.col("n"), F.col("tokens")
    literal = T.prefix_key(tokens, n, options.depth, False, options.wildcard)
    general = T.prefix_key(tokens, n, options.depth, True, options.wildcard)
    return templates.select(
        F.col(id_col), n,
        F.explode(F.array(
            F.struct(key_text(literal).alias("key"), F.lit("literal").alias("kind")),
            F.struct(key_text(general).alias("key"), F.lit("wildcard").alias("kind")),
        )).alias("k")).select(id_col, "n", "k.key", "k.kind")


def wildcard_edges(shapes: DataFrame, keys: DataFrame, options: MinerOptions,
                   prefer: str = "literal", id_col: str = "shape_id",
                   template_col: str = "template_id") -> DataFrame:
    """Candidate templates per shape: its literal key and its wildcard key are
    both tried, and only the preferred kind that exists is kept.

    Returns ``(shape, template, kind)``. ``keys`` comes from ``template_keys``.
    """
    n, tokens = F.col("n"), F.col("tokens")
    literal = key_text(T.prefix_key(tokens, n, options.depth, False, options.wildcard))
    general = key_text(T.prefix_key(tokens, n, options.depth, True, options.wildcard))
    first, second = ("literal", "wildcard") if prefer == "literal" else ("wildcard", "literal")
    tried = F.array(
        F.struct(literal.alias("key"), F.lit("literal").alias("kind")),
        F.struct(general.alias("key"), F.lit("wildcard").alias("kind")))
    probes = shapes.select(id_col, "n", F.explode(tried).alias("k")).select(id_col, "n", "k.*")
    kinds = keys.select("n", "key", "kind").distinct()
    reachable = probes.join(kinds, ["n", "key", "kind"])
    order = F.when(F.col("kind") == first, 0).otherwise(1)
    chosen = (reachable.groupBy(id_col, "n")
              .agg(F.min_by(F.struct("key", "kind"), order).alias("k"))
              .select(id_col, "n", "k.*"))
    return chosen.join(keys, ["n", "key", "kind"]).select(id_col, template_col, "kind")


def block_report(shapes: DataFrame, depth: int = 2) -> DataFrame:
    """Sizes of every block and of its parents: by length, then by each of the
    first ``depth`` tokens. ``level`` tells how many of them a row fixes."""
    cols = [F.coalesce(F.try_element_at("tokens", F.lit(i + 1)), F.lit("")).alias(f"tok{i + 1}")
            for i in range(depth)]
    names = [f"tok{i + 1}" for i in range(depth)]
    rolled = (shapes.select("n", "cnt", *cols).rollup("n", *names)
              .agg(F.grouping_id().alias("_g"), F.count("*").alias("shapes"),
                   F.sum("cnt").alias("lines"), F.max("cnt").alias("largest")))
    level = F.lit(depth + 1) - F.bit_count("_g")
    return rolled.select(
        level.cast("long").alias("level"), F.coalesce("n", F.lit(-1)).cast("long").alias("n"),
        *[F.coalesce(c, F.lit("*")).alias(c) for c in names], "shapes", "lines", "largest")
