"""Mining templates from lines in batch.

Sequential insertion depends on the order of lines and keeps one worker busy.
Here the result is defined without an order. Work runs on distinct shapes, in
three passes over blocks of the same token count: by leading tokens, by
trailing tokens, and by the count alone. In one pass

* members of a block are ranked by lines (then first line, then id);
* a member is a *leader* if no leader ranked above it is similar enough;
* every other member joins the leader it is most similar to.

The members of a leader are folded into one template, and the templates of one
pass are the members of the next.

Blocks that one task can hold are compared there as numbers, see
``operators.whole_blocks``; the others in parts, as follows.

The first ``round_leaders`` members of each block are tried at once: members meet
their block's leaders in one row, no pairs are written. Most blocks are done with
that. Blocks with members that have no leader yet go on with candidates from an
index of rare marks and parallel rounds, see ``operators.leaders``. A block stays
whole all the way, so ``round_leaders`` shapes the work, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from loomline.functions import facts as R
from loomline.functions import similarity as S
from loomline.functions import tokens as T
from loomline.operators.blocks import cap_children, key_text
from loomline.operators.leaders import (
    GROWTH, Rounds, find_leaders, mark_index, nearest_leaders, placed_members)
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.operators.merging import agreed_words, deal_groups, keep_agreed, once
from loomline.operators.ranking import top_per_group
from loomline.operators.whole_blocks import nearest_in_whole, too_large
from loomline.options import MinerOptions
from loomline.session import release, stage


@dataclass(frozen=True)
class Mined:
    """Result of one mining job.

    ``shapes``: distinct token sequences; ``lineage``: shape to the template of
    each pass; ``templates``: the catalog. ``tagged`` holds the mined lines with
    their shape, as written by the one pass that masks them; ``source`` is the
    table it was made from.
    """

    shapes: DataFrame
    lineage: DataFrame
    templates: DataFrame
    tagged: DataFrame | None = None
    source: DataFrame | None = None


def literal_marks(tokens: Column, wildcard: str) -> Column:
    """The literals of a sequence, each with its position. Two sequences of the
    same length agree in as many positions as their marks have in common."""
    tagged = F.transform(tokens, lambda t, i: F.concat(i.cast("string"), F.lit(T.SEP), t))
    plain = F.transform(tokens, lambda t: t != wildcard)
    return F.when(F.forall(plain, lambda p: p), tagged).otherwise(F.filter(
        tagged, lambda m: ~m.endswith(T.SEP + wildcard)))


def shown_columns(options: MinerOptions) -> list[str]:
    """What a comparison reads of a member."""
    rules = options.dictionary_veto or options.pos_veto
    return ["marks", "params"] + (["tokens"] if options.static_veto or rules else []) + (["facts"] if rules else [])


def compare(leader: Column, member: Callable[[str], Column], n: Column, options: MinerOptions) -> Column:
    """Similarity of a leader struct and a member; a veto makes it zero."""
    common = F.size(F.array_intersect(leader["marks"], member("marks")))
    sim = F.when(n == 0, F.lit(1.0)).otherwise(common.cast("double") / n)
    if options.dictionary_veto or options.pos_veto:
        veto = R.veto_by_facts(leader["tokens"], member("tokens"), leader["facts"], member("facts"),
                               options.static_veto, options.dictionary_veto, options.pos_veto)
    elif options.static_veto:
        veto = S.static_position_veto(leader["tokens"], member("tokens"),
                                      options.mask_prefix, options.mask_suffix)
    else:
        return sim
    return F.when((sim >= S.threshold(n, options.sim_th)) & veto, F.lit(0.0)).otherwise(sim)


def choose_leaders(open_members: DataFrame, options: MinerOptions) -> DataFrame:
    """``(block, leaders)``: the top ranked members of each block that no kept
    one above them covers; ``tokens`` come packed. At most ``round_leaders`` per block;
    the rank limit runs before the shuffle as well, so large blocks send few rows."""
    order = [F.desc("known"), F.desc("cnt"), F.asc("first_id"), F.asc("node_id")]
    facts = [c for c in ("facts",) if c in shown_columns(options)]
    top = top_per_group(open_members.select("block", "n", "known", "cnt", "first_id", "node_id", "tokens", *facts),
                        ["block"], order, options.round_leaders, F.col("node_id"), "rn")
    listed = top.groupBy("block", "n").agg(
        F.array_sort(F.collect_list(F.struct("rn", "node_id", "tokens", *facts))).alias("packed"))

    def shown(row: Column) -> Column:
        return once(T.unpack_tokens(row["tokens"]), lambda tokens: F.struct(
            row["rn"].alias("rn"), row["node_id"].alias("node_id"), *read_columns(
                tokens, row["facts"] if facts else None, options)))

    listed = listed.select("block", "n", F.explode(F.array(F.transform("packed", shown))).alias("ranked"))
    n = F.col("n")

    def keep(kept: Column, candidate: Column) -> Column:
        covered = F.exists(kept, lambda k: compare(k, candidate.getField, n, options)
                           >= S.threshold(n, options.sim_th))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(candidate)))

    none = F.slice("ranked", 1, 0)
    return listed.select("block", F.aggregate("ranked", none, keep).alias("leaders"))


def _nearest(leaders: Column, options: MinerOptions) -> Column:
    """Best leader of the first try as an ordered struct: similarity, wildcards,
    earlier rank; a leader is its own best. What is read of the member is made once."""
    def nearest(member: Column) -> Column:
        def scored(leader: Column) -> Column:
            own = leader["node_id"] == F.col("node_id")
            return F.struct(
                F.when(own, F.lit(2.0)).otherwise(compare(leader, member.getField, F.col("n"), options)).alias("sim"),
                leader["params"].alias("params"), (-leader["rn"]).cast("long").alias("rank"),
                leader["node_id"].alias("leader_id"))

        return F.array_max(F.transform(leaders, scored))

    facts = F.col("facts") if "facts" in shown_columns(options) else None
    return once(F.struct(*read_columns(F.col("tokens"), facts, options)), nearest)


def assign_to_leaders(nodes: DataFrame, options: MinerOptions, rounds: Rounds | None = None) -> DataFrame:
    """One pass: ``nodes(node_id, block, n, tokens, cnt, first_id, ...)`` with
    ``leader_id`` added; all other columns but ``block`` are carried along.

    Blocks that one task can hold are compared there as numbers, each whole; the others
    in parts. Vetoes without facts read patterns, so they go in parts too.
    """
    tokens, whole, parted = split_blocks(nodes, options)
    near = None if whole is None else stage(nearest_in_whole(whole, tokens, options), "members")
    if parted is None:
        return near
    found = assign_in_parts(parted, options, rounds)
    return found if near is None else near.unionByName(found)


def split_blocks(nodes: DataFrame, options: MinerOptions) -> tuple[int, DataFrame | None, DataFrame | None]:
    """The number of all tokens, the nodes of blocks that one task can hold, and the others;
    None where there are none."""
    if options.static_veto and "facts" not in nodes.columns:
        return 0, None, nodes
    sizes, seen = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")), Observation()
    large = stage(sizes.observe(seen, F.sum(F.col("rows") * F.greatest("n", F.lit(1))).alias("tokens")).filter(
        too_large(F.col("rows"), F.col("n"))).select("block"), "large")
    tokens = seen.get["tokens"] or 0
    if large.isEmpty():
        return tokens, nodes, None
    return tokens, nodes.join(large, "block", "left_anti"), nodes.join(large, "block", "left_semi")


def fold_blocks(nodes: DataFrame, keys: Sequence[str], options: MinerOptions) -> tuple[DataFrame, DataFrame]:
    """One pass: the templates that ``nodes`` with their ``block`` become, and the pairs
    ``(node_id, leader_id)``. Blocks that one task can hold are folded there as well."""
    tokens, whole, parted = split_blocks(nodes, options)
    templates, steps = [], []
    if whole is not None:
        members = stage(nearest_in_whole(whole, tokens, options, folded=True), "members")
        templates.append(members.filter(F.col("node_id") == F.col("leader_id")).drop("leader_id"))
        steps.append(members.select("node_id", "leader_id"))
    if parted is not None:
        assigned = assign_in_parts(parted, options)
        templates.append(stage(_fold(assigned, keys, options), "templates"))
        steps.append(assigned.select("node_id", "leader_id"))
    return reduce(DataFrame.unionByName, templates), reduce(DataFrame.unionByName, steps)


def assign_in_parts(nodes: DataFrame, options: MinerOptions, rounds: Rounds | None = None) -> DataFrame:
    """``assign_to_leaders`` for blocks of any size.

    One job writes all members with their best leader so far and counts on the way
    how many are without one; only blocks that hold such members go on.
    """
    open_ = F.col("near.sim") < S.threshold(F.col("n"), options.sim_th)
    carried = [c for c in nodes.columns if c != "block"]
    packed = nodes.withColumn("tokens", T.pack_tokens(F.col("tokens")))
    dealt, leaders = deal_groups(packed, choose_leaders(packed, options), ["block"], "node_id")
    met = dealt.join(leaders, ["block", "_part"]).withColumn("tokens", T.unpack_tokens(F.col("tokens")))
    compared = met.withColumn("near", _nearest(F.col("leaders"), options)).drop("leaders", "_part")
    still_open = Observation()
    members = stage(compared.observe(still_open, F.count_if(open_).alias("rows")), "members")
    if not still_open.get["rows"]:
        return members.select(*carried, "near.leader_id")
    crowded = stage(members.filter(open_).select("block").distinct(), "crowded")
    near = nearest_in_crowded(members.join(crowded, "block", "left_semi"), open_, options, rounds or Rounds())
    return members.join(near, "node_id", "left").select(
        *carried, F.greatest("near", "later").getField("leader_id").alias("leader_id"))


def read_columns(tokens: Column, facts: Column | None, options: MinerOptions) -> list[Column]:
    """What comparisons read of a member, ``shown_columns``: its marks and ``params``, its
    wildcards, and for vetoes its tokens and facts."""
    made = {"marks": literal_marks(tokens, options.wildcard), "tokens": tokens, "facts": facts,
            "params": F.size(F.filter(tokens, lambda t: t == options.wildcard))}
    return [made[c].alias(c) for c in shown_columns(options)]


def with_marks(nodes: DataFrame, options: MinerOptions) -> DataFrame:
    """Nodes with what comparisons read."""
    facts = F.col("facts") if "facts" in nodes.columns else None
    return nodes.withColumns({c: v for c, v in zip(shown_columns(options), read_columns(F.col("tokens"), facts, options))})


def nearest_in_crowded(members: DataFrame, open_: Column, options: MinerOptions, rounds: Rounds) -> DataFrame:
    """``(node_id, later)``: the best of the leaders beyond the first try, for the
    members of blocks that need some. They rank below those of the first try."""
    th = S.threshold(F.col("n"), options.sim_th)
    placed = placed_members(members)
    slim = stage(with_marks(placed, options).select("place", "n", *shown_columns(options)), "slim")
    index = mark_index(placed, th, options.wildcard)

    def sim(a: Column, b: Column, n: Column) -> Column:
        return compare(a, b.getField, n, options)

    leaders = find_leaders(slim, index, placed.filter(open_).select("place"), sim, th,
                           GROWTH * options.round_leaders, rounds)
    ids = placed.select("place", "node_id")
    best = nearest_leaders(slim, index, leaders, sim, th).join(
        ids.select(F.col("place").alias("leader"), F.col("node_id").alias("leader_id")), "leader").join(ids, "place")
    rank = -(F.col("leader") + options.round_leaders + 1)
    near = stage(best.select("node_id", F.struct("sim", "params", rank.alias("rank"), "leader_id").alias("later")), "near")
    release(placed, slim, index)
    return near


def _fold(assigned: DataFrame, keys: Sequence[str], options: MinerOptions) -> DataFrame:
    """Members to templates: folded tokens, summed sizes, id of the leader.

    The leader's tokens and facts, with the wildcard and its fact where a member has
    another token. Leaders alone in their group are not compared with anything.
    """
    facts_too = "facts" in assigned.columns
    kept = {"known": F.max, "cnt": F.sum, "first_id": F.min, "last_id": F.max, "shapes": F.sum}
    sums = assigned.groupBy("leader_id").agg(*[f(c).alias(c) for c, f in kept.items()])
    packed = assigned.select("node_id", "leader_id", *keys, "n", T.pack_tokens(F.col("tokens")).alias("_packed"),
                             *(["facts"] if facts_too else []))
    own = F.col("node_id") == F.col("leader_id")
    first = packed.filter(own).drop("node_id").withColumnRenamed("_packed", "_first")
    agreed = agreed_words(first.select("leader_id", "_first"), packed.filter(~own).select("leader_id", "_packed"),
                          ["leader_id"])
    joined = first.join(sums, "leader_id").join(agreed, "leader_id", "left").withColumn(
        "tokens", T.unpack_tokens(F.col("_first")))

    def folded(column: str, wildcard: Column) -> Column:
        return F.when(F.col("_words").isNull(), F.col(column)).otherwise(
            keep_agreed(F.col(column), F.col("_words"), wildcard)).alias(column)

    return joined.select(*keys, F.col("leader_id").alias("node_id"), "n", folded("tokens", F.lit(options.wildcard)), *kept,
                         *([folded("facts", R.wildcard_fact(options))] if facts_too else []))


def _block(kind: str, keys: Sequence[str]) -> Column:
    key = key_text(F.col("key")) if kind != "length" else F.lit("")
    return F.md5(F.concat_ws(T.SEP, *[F.col(k) for k in keys],
                             F.col("n").cast("string"), key))


def block_nodes(nodes: DataFrame, kind: str, keys: Sequence[str], options: MinerOptions
                ) -> DataFrame:
    """Add the ``block`` of one pass: ``prefix``, ``suffix`` or ``length``."""
    n, tokens = F.col("n"), F.col("tokens")
    if kind == "prefix":
        keyed = nodes.withColumn("key", T.prefix_key(
            tokens, n, options.depth, options.numeric_tokens, options.wildcard))
        levels = max(options.depth - 3, 0)
        if levels:
            keyed = cap_children(keyed, "key", levels, options, keys)
    elif kind == "suffix":
        keyed = nodes.withColumn("key", T.suffix_key(
            tokens, n, options.depth, options.numeric_tokens, options.wildcard))
    else:
        keyed = nodes.withColumn("key", F.array().cast("array<string>"))
    return keyed.withColumn("block", _block(kind, keys)).drop("key")


def mine_nodes(nodes: DataFrame, options: MinerOptions, keys: Sequence[str] = (),
               lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Run all passes over ``nodes``; returns (templates, lineage).

    Nodes: ``(keys…, node_id, known, n, tokens, cnt, first_id, last_id,
    shapes)``. ``known`` nodes (templates of an earlier catalog) rank before
    others, so their ids live on. Lineage: ``(keys…, node_id, template_id)``
    with the template of each pass as ``t1, t2, …``. The vetoes by words read
    ``lexicon(token, known, tag)``.
    """
    keys = list(keys)
    if options.dictionary_veto or options.pos_veto:
        if lexicon is None:
            raise ValueError("dictionary_veto and pos_veto need a lexicon")
        nodes = stage(R.with_facts(nodes, lexicon, options), "facts")
    lineage = nodes.select(*keys, F.col("node_id").alias("t0"))
    kinds = ["prefix", "suffix", "length"] if options.reverse_blocks else ["prefix", "length"]
    for i, kind in enumerate(kinds, start=1):
        nodes, step = fold_blocks(block_nodes(nodes, kind, keys, options), keys, options)
        lineage = lineage.join(step.toDF(f"t{i - 1}", f"t{i}"), f"t{i - 1}")
    lineage = stage(
        lineage.withColumn("template_id", F.col(f"t{len(kinds)}"))
        .withColumnRenamed("t0", "node_id"), "lineage")
    templates = nodes.select(*keys, F.col("node_id").alias("template_id"), "n", "tokens",
                             F.col("cnt").alias("size"), "shapes", "first_id", "last_id")
    return templates, lineage


def mine_shapes(shapes: DataFrame, options: MinerOptions, keys: Sequence[str] = (),
                lexicon: DataFrame | None = None) -> Mined:
    """Mine templates from ``distinct_shapes``. Extra ``keys`` (a dataset, a
    source, a day) keep groups apart inside one job."""
    keys = list(keys)
    node_id = F.md5(F.concat_ws(T.SEP, *keys, "shape_id")) if keys else F.col("shape_id")
    shapes = stage(shapes.withColumn("node_id", node_id), "shapes")
    nodes = shapes.select(
        *keys, "node_id", F.lit(0).alias("known"), "n", "tokens", "cnt", "first_id", "last_id",
        F.lit(1).cast("long").alias("shapes"))
    templates, lineage = mine_nodes(nodes, options, keys, lexicon)
    lineage = shapes.select("node_id", "shape_id").join(lineage, "node_id").drop("node_id")
    return Mined(shapes.drop("node_id"), lineage, templates)


def mine_templates(lines: DataFrame, options: MinerOptions, keys: Sequence[str] = (),
                   text_col: str = "text", id_col: str = "line_id",
                   lexicon: DataFrame | None = None) -> Mined:
    """Lines to a catalog of templates. Lines are masked and tokenised once: the
    result is written, and both the shapes and ``assign_lines`` read it."""
    tagged = stage(tag_lines(lines, options, text_col), "tagged")
    shapes = distinct_shapes(tagged, keys, id_col)
    return replace(mine_shapes(shapes, options, keys, lexicon), tagged=tagged.drop("tokens"), source=lines)


def tag_lines(lines: DataFrame, options: MinerOptions, text_col: str = "text") -> DataFrame:
    """Lines with ``tokens`` and ``shape_id``."""
    return with_tokens(lines, options, text_col).withColumn(
        "shape_id", T.content_id(F.col("tokens")))


def assign_lines(lines: DataFrame, mined: Mined, options: MinerOptions,
                 keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """Add ``template_id`` to every line by its shape.

    Lines that ``mined`` was made from are not masked again. The lineage has one
    row per shape; a shape with a large share of the lines stays spread because
    the planner broadcasts the small side or splits it.
    """
    keys = list(keys)
    tagged = mined.tagged if lines is mined.source else (
        tag_lines(lines, options, text_col).drop("tokens"))
    return tagged.join(mined.lineage.select(*keys, "shape_id", "template_id"),
                       [*keys, "shape_id"]).drop("shape_id")
