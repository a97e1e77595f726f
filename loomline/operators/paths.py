"""Every key under which a template ever got members, as a trie in rows.

A key is a path of tokens; a node of the trie is ``(n, path)`` with ``path`` a hash of the
tokens down to it, an edge leads from a node by a token to the next. The history has a row
for each key that a template had, with the batch it came in. The keys of its tokens today
are not enough: a rare token may have stood for the wildcard when a prefix had too many
children, and a template may be folded or cut anew. A key whose every token is covered by the
wildcards of another key of the same template says nothing new and is left out.

Shapes walk down level by level as a frontier of rows: from a node both the edge of the
token and the edge of the wildcard are taken, where the wildcard may have a set of tokens
that it stands for. Both branches are kept; ``prefer`` only ranks what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomline.functions import tokens as T
from loomline.operators.blocks import cap_children, key_text
from loomline.options import MinerOptions
from loomline.session import release, stage

ROOT = 0


def member_keys(members: DataFrame, options: MinerOptions, batch: int = 0, capped: bool = False) -> DataFrame:
    """``(template_id, n, key, batch)`` of the keys that members of templates came by. With
    ``capped`` rare tokens under a crowded prefix are the wildcard, as in mining; members
    then carry their lines ``cnt``."""
    key = T.prefix_key(F.col("tokens"), F.col("n"), options.depth, options.numeric_tokens, options.wildcard)
    keyed = members.withColumn("key", key)
    if capped and options.depth > 3:
        keyed = cap_children(keyed, "key", options.depth - 3, options)
    return keyed.select("template_id", "n", "key").distinct().withColumn("batch", F.lit(batch))


def add_keys(history: DataFrame | None, fresh: DataFrame, options: MinerOptions,
             lineage: DataFrame | None = None) -> DataFrame:
    """The history with new keys; ``lineage(template_id, to_id)`` moves those of templates
    that were merged. Of a key that came twice the first batch counts."""
    if history is not None and lineage is not None:
        history = history.join(lineage, "template_id", "left").withColumn(
            "template_id", F.coalesce("to_id", "template_id")).drop("to_id")
    both = fresh if history is None else history.unionByName(fresh)
    kept = both.groupBy("template_id", "n", "key").agg(F.min("batch").alias("batch"))
    return without_covered(kept, options)


def without_covered(keys: DataFrame, options: MinerOptions) -> DataFrame:
    """Drop keys that a more general key of the same template covers.

    A covering key has the same tokens but for wildcards, so each key asks for its own
    generalisations, which are as many as there are subsets of a short key's tokens.
    """
    wild = F.lit(options.wildcard)

    def grow(made: Column, token: Column) -> Column:
        return F.concat(
            F.transform(made, lambda k: F.concat(k, F.array(token))),
            F.when(token != wild, F.transform(made, lambda k: F.concat(k, F.array(wild))))
            .otherwise(F.slice(made, 1, 0)))

    start = F.array(F.array().cast("array<string>"))
    asked = keys.select("template_id", "n", "key", F.explode(F.aggregate("key", start, grow)).alias("general")).filter(
        F.col("general") != F.col("key"))
    covered = asked.join(keys.select("template_id", "n", F.col("key").alias("general")),
                         ["template_id", "n", "general"], "left_semi").select("template_id", "n", "key").distinct()
    return keys.join(covered, ["template_id", "n", "key"], "left_anti")


def trie_edges(history: DataFrame) -> DataFrame:
    """``(n, level, above, token, node)``, one row an edge of the trie."""
    start = F.struct(F.lit(ROOT).cast("long").alias("node"),
                     F.array().cast("array<struct<level:int,above:bigint,token:string,node:bigint>>").alias("edges"))

    def step(s: Column, t: Column) -> Column:
        node = F.xxhash64(s["node"], t)
        edge = F.struct(F.size(s["edges"]).alias("level"), s["node"].alias("above"), t.alias("token"), node.alias("node"))
        return F.struct(node.alias("node"), F.concat(s["edges"], F.array(edge)).alias("edges"))

    return history.select("n", F.inline(F.aggregate("key", start, step, lambda s: s["edges"]))).distinct()


def path_node(key: Column) -> Column:
    """The node that a key ends at."""
    return F.aggregate(key, F.lit(ROOT).cast("long"), lambda above, t: F.xxhash64(above, t))


def reached_templates(shapes: DataFrame, history: DataFrame, options: MinerOptions,
                      seen: DataFrame | None = None) -> DataFrame:
    """``(shape_id, template_id, key, batch, literals)``: the templates whose keys a shape
    reaches, ``literals`` the tokens of the key that are none of the wildcard.

    Shapes go as their distinct heads. With ``seen(n, level, token)`` a wildcard is only
    taken for a token that stood there before.
    """
    head = F.slice("tokens", F.lit(1), T.prefix_key_length(F.col("n"), options.depth))
    headed = shapes.select("shape_id", "n", head.alias("head"))
    edges = stage(trie_edges(history), "edges")
    frontier = headed.select("n", "head").distinct().withColumn("node", F.lit(ROOT).cast("long"))
    released: list[DataFrame] = [edges]
    depth = history.agg(F.max(F.size("key"))).first()[0] or 0
    for level in range(depth):
        here = F.get("head", F.lit(level))
        wild = F.array(F.struct(here.alias("token"), F.lit(False).alias("wild")),
                       F.struct(F.lit(options.wildcard).alias("token"), F.lit(True).alias("wild")))
        tried = frontier.filter(here.isNotNull()).select(
            "n", "head", F.col("node").alias("above"), here.alias("own"), F.inline(F.array_distinct(wild)))
        if seen is not None:
            allowed = seen.filter(F.col("level") == level).select("n", F.col("token").alias("own")).withColumn("ok", F.lit(True))
            tried = tried.join(allowed, ["n", "own"], "left").filter(
                ~F.col("wild") | F.coalesce("ok", F.lit(False)) | (F.col("own") == options.wildcard)).drop("ok")
        ended = frontier.filter(here.isNull())
        onward = tried.join(edges.filter(F.col("level") == level).drop("level"), ["n", "above", "token"]).select(
            "n", "head", "node").distinct()
        frontier = stage(onward.unionByName(ended), "frontier")
        released.append(frontier)
    literals = F.size(F.filter("key", lambda t: t != options.wildcard))
    ends = history.select("template_id", "n", "key", "batch", path_node(F.col("key")).alias("node"), literals.alias("literals"))
    found = stage(headed.join(frontier, ["n", "head"]).join(ends, ["n", "node"]).select(
        "shape_id", "template_id", key_text(F.col("key")).alias("key"), "batch", "literals"), "reached")
    release(*released)
    return found


def reached_counts(shapes: DataFrame, history: DataFrame, current: DataFrame, options: MinerOptions) -> DataFrame:
    """``(shape_id, reached, by_old_keys)``: how many templates each shape reaches by the keys of
    ``history``, and how many of those ``current`` does not lead it to.

    Shapes go as distinct heads and templates as distinct keys. With keys of one token a head
    reaches a template by one key of those that no other key covers, so templates are counted
    by their keys and no row is made for a shape and a template. Longer keys of a template may
    overlap; then the pairs are listed.
    """
    shapes = shapes.select("shape_id", "n", F.slice("tokens", F.lit(1), T.prefix_key_length(
        F.col("n"), options.depth)).alias("tokens"))
    if options.depth > 4:
        old, now = (reached_templates(shapes, keys, options).select("shape_id", "template_id").distinct()
                    for keys in (history, current))
        both = old.join(now.withColumn("now", F.lit(True)), ["shape_id", "template_id"], "left")
        return both.groupBy("shape_id").agg(F.count(F.lit(1)).alias("reached"),
                                            F.count_if(F.col("now").isNull()).alias("by_old_keys"))
    heads = stage(shapes.select("n", "tokens").distinct().withColumn(
        "shape_id", F.md5(F.to_json(F.struct("n", "tokens")))), "heads")
    sides = []
    for keys, name in ((history, "old"), (current, "now")):
        kept = stage(without_covered(keys, options).select(
            "template_id", "n", "key", F.to_json("key").alias(name)).distinct(), "keys")
        classes = kept.select("n", "key", F.col(name).alias("template_id")).distinct().withColumn("batch", F.lit(0))
        met = reached_templates(heads, classes, options).select("shape_id", F.col("template_id").alias(name))
        sides.append((kept.drop("key"), met))
    (old_keys, old), (now_keys, now) = sides
    met = heads.select("shape_id", "n").join(old, "shape_id")
    reached = met.join(old_keys.groupBy("n", "old").agg(F.count(F.lit(1)).alias("c")), ["n", "old"]).groupBy(
        "shape_id").agg(F.sum("c").alias("reached"))
    pairs = old_keys.join(now_keys, ["template_id", "n"]).groupBy("n", "old", "now").agg(F.count(F.lit(1)).alias("c"))
    both = met.join(now, "shape_id").join(pairs, ["n", "old", "now"]).groupBy("shape_id").agg(F.sum("c").alias("both"))
    counted = reached.join(both, "shape_id", "left").join(heads, "shape_id").select(
        "n", "tokens", "reached", (F.col("reached") - F.coalesce("both", F.lit(0))).alias("by_old_keys"))
    return shapes.join(counted, ["n", "tokens"]).select("shape_id", "reached", "by_old_keys")


def preferred(reached: DataFrame, prefer: str = "literal") -> DataFrame:
    """One template a shape: of most literals (``literal``) or of fewest (``wildcard``)."""
    first = F.desc("literals") if prefer == "literal" else F.asc("literals")
    order = W.partitionBy("shape_id").orderBy(first, "batch", "key", "template_id")
    return reached.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
