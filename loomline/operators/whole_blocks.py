"""Leaders of blocks that one task can hold, compared as numbers.

A block of bounded work goes to one task as rows of numbers, one for each token. Members are
compared position by position for many pairs at once: first by one byte a token, which may
only find too many, then what is left by the numbers themselves. Members are taken in the
order of their rank, so the leaders are those of the plain definition, see ``plans.mining``.
Blocks beyond the bounds go by ``operators.leaders``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomline.functions import similarity as S
from loomline.functions.facts import BIT, wildcard_fact
from loomline.operators import merging as G
from loomline.options import MinerOptions

TOKENS = 1 << 22  # of a block
WORK = 1 << 37  # pairs of members times tokens
PIECE_TOKENS = 1 << 18
TILE, WIDTH, FEW = 128, 1 << 13, 12
RANK = [("known", "descending"), ("cnt", "descending"), ("first_id", "ascending"), ("node_id", "ascending")]


def too_large(rows: Column, n: Column) -> Column:
    """Blocks that are not held by one task."""
    tokens = rows * F.greatest(n, F.lit(1))
    return (rows > 8 * G.PART_ROWS) | (tokens > TOKENS) | (rows.cast("double") * tokens > WORK)


class Block:
    """Members of one block in the order of their rank."""

    def __init__(self, codes: np.ndarray, wild: np.ndarray, th: float, vetoes: "Vetoes | None", rows: np.ndarray) -> None:
        self.size, self.n = codes.shape
        shares = np.arange(self.n + 1) / self.n if self.n else np.ones(1)
        enough = np.flatnonzero(shares >= th)
        self.need = int(enough[0]) if len(enough) else self.n + 1
        self.params = wild.sum(axis=1)
        # A wildcard equals nothing, so it has one number as a leader's and another as a member's.
        self.leader, self.member = np.where(wild, -1, codes), np.where(wild, -2, codes)
        self.vetoes, self.rows = vetoes, rows
        if self.size > FEW:
            short = (codes % 251 + 1).astype(np.uint8)
            self.short_leader = np.ascontiguousarray(np.where(wild, np.uint8(0), short).T)
            self.short_member = np.ascontiguousarray(np.where(wild, np.uint8(255), short).T)

    def likely(self, leaders: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(member, leader)`` that may be similar, none missing."""
        if self.size <= FEW or self.need > self.n:
            return np.nonzero(np.full((len(members), len(leaders)), self.need <= self.n))
        left, right = self.short_leader[:, leaders], self.short_member[:, members]
        equal = np.empty((len(members), len(leaders)), dtype=bool)
        common = np.zeros(equal.shape, dtype=np.uint8 if self.n < 256 else np.uint16)
        # All that agree in `need` positions agree in some of the first ones.
        first = min(self.n, self.n - self.need + max(2, self.need // 4))
        for place in range(self.n):
            if place == first:
                found = np.flatnonzero(common >= self.need - (self.n - first))
                if len(found) * 64 < common.size:
                    return np.divmod(found, len(leaders))
            np.equal(right[place][:, None], left[place][None, :], out=equal)
            np.add(common, equal.view(np.uint8), out=common)
        return np.divmod(np.flatnonzero(common >= self.need), len(leaders))

    def similar(self, leaders: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(member, leader, common)`` of the similar pairs as places in the two lists, by
        member, then leader."""
        member, leader = self.likely(leaders, members)
        step, parts = max(1, (1 << 20) // max(self.n, 1)), []
        for at in range(0, len(member), step):
            m, a = member[at:at + step], leader[at:at + step]
            common = (self.leader[leaders[a]] == self.member[members[m]]).sum(axis=1)
            near = common >= self.need
            m, a, common = m[near], a[near], common[near]
            if self.vetoes is not None and len(m):
                free = ~self.vetoes.apply(self.rows[leaders[a]], self.rows[members[m]], self.n)
                m, a, common = m[free], a[free], common[free]
            parts.append((m, a, common))
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(p) for p in zip(*parts))

    def leaders(self) -> np.ndarray:
        """Members that no leader above them covers."""
        found, count = np.empty(self.size, dtype=np.int64), 0
        for at in range(0, self.size, TILE):
            rows = np.arange(at, min(at + TILE, self.size))
            for low in range(0, count, WIDTH):
                covered = np.zeros(len(rows), dtype=bool)
                covered[self.similar(found[low:min(low + WIDTH, count)], rows)[0]] = True
                rows = rows[~covered]
            member, leader, _ = self.similar(rows, rows)
            below = leader < member
            member, leader = member[below], leader[below]
            order = np.argsort(leader, kind="stable")
            firsts, starts = np.unique(leader[order], return_index=True)
            fallen = np.zeros(len(rows), dtype=bool)
            for one, those in zip(firsts, np.split(member[order], starts[1:])):
                if not fallen[one]:
                    fallen[those] = True
            fresh = rows[~fallen]
            found[count:count + len(fresh)] = fresh
            count += len(fresh)
        return found[:count]

    def nearest(self) -> np.ndarray:
        """The leader of each member: most similar, then most wildcards, then first in rank."""
        leaders, out = self.leaders(), np.arange(self.size)
        leads = np.zeros(self.size, dtype=bool)
        leads[leaders] = True
        others = np.flatnonzero(~leads)
        for at in range(0, len(others), TILE):
            rows = others[at:at + TILE]
            best = np.full(len(rows), -1, dtype=np.int64)
            for low in range(0, len(leaders), WIDTH):
                some = leaders[low:low + WIDTH]
                member, leader, common = self.similar(some, rows)
                score = common.astype(np.int64) * (self.n + 1) + self.params[some[leader]]
                order = np.lexsort((leader, -score, member))
                member, leader, score = member[order], leader[order], score[order]
                first = np.flatnonzero(np.r_[True, member[1:] != member[:-1]]) if len(member) else member
                member, leader, score = member[first], leader[first], score[first]
                better = score > best[member]
                best[member[better]] = score[better]
                out[rows[member[better]]] = some[leader[better]]
        return out


class Vetoes:
    """``functions.facts.veto_by_facts`` for pairs of rows with tokens as numbers."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, bits: np.ndarray, heads: np.ndarray,
                 marks: dict[str, int], options: MinerOptions) -> None:
        self.codes, self.starts, self.bits, self.heads, self.marks, self.options = codes, starts, bits, heads, marks, options

    def apply(self, template: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(len(template), dtype=bool)
        at = [self.starts[rows][:, None] + np.arange(n) for rows in (template, line)]
        edge = np.zeros((len(template), 1), dtype=np.int64)

        def padded(values: np.ndarray, outside: int) -> list[np.ndarray]:
            return [np.hstack([edge + outside, values[a], edge + outside]) for a in at]

        tokens, facts, heads = padded(self.codes, -9), padded(self.bits, 0), padded(self.heads, 0)
        here, before, after = slice(1, n + 1), slice(0, n), slice(2, n + 2)

        def either(name: str, where: slice = here) -> np.ndarray:
            return ((facts[0] | facts[1])[:, where] & BIT[name]) != 0

        def both(name: str, where: slice = here) -> np.ndarray:
            return ((facts[0] & facts[1])[:, where] & BIT[name]) != 0

        def has(name: str, where: slice = here, side: int = 0) -> np.ndarray:
            return (facts[side][:, where] & BIT[name]) != 0

        def same(where: slice) -> np.ndarray:
            return tokens[0][:, where] == tokens[1][:, where]

        def any_at(where: slice, *texts: str, sides: tuple[int, ...] = (0, 1)) -> np.ndarray:
            listed = [self.marks[t] for t in texts]
            found = [np.isin(tokens[side][:, where], listed) for side in sides]
            return found[0] | found[-1]

        place = np.arange(1, n + 1)
        inner, opening, last = (place > 1) & (place < n), place == 1, (place == n) & (place > 1)
        found = np.zeros((len(template), n), dtype=bool)
        if self.options.static_veto:
            value_follows, colon = any_at(after, "=", ":", sides=(1,)), any_at(before, ":")
            found |= ((n == 1) | both("named") | either("caps") | (opening & (value_follows | either("scoped")))
                      | (inner & value_follows)
                      | (both("caps") & colon & (last | (inner & ~any_at(after, ",", ".", ":")))))
        if self.options.dictionary_veto:
            between = same(before) & same(after) & ~has("link", before)
            found |= inner & both("known") & (between | (any_at(before, "=", ":") & any_at(after, ",", ".", ":")))
        if self.options.pos_veto:
            opens = opening & ~either("path") & ~either("verb_first", after)
            free = ((place > 1) & ~either("path") & ~any_at(before, ":", "=") & ~either("link", before) & ~both("digit")
                    & ~(same(before) & either("leads_in", before)))
            verb_after_link = (place > 1) & has("verb") & has("link", before)
            found |= (either("function") | (heads[0] != heads[1])[:, here]
                      | (either("content") & (opens | free | verb_after_link)))
        comparable = ~same(here) & (~either("digit") | both("caps")) & ~either("mask")
        return (comparable & found).any(axis=1)


def values_of(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and where each list begins."""
    one = lists.combine_chunks()
    offsets = one.offsets.to_numpy()
    return one.flatten(), (offsets - offsets[0])[:-1]


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = pc.fill_null(values, "").dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


class Fold:
    """The templates of the groups that members make with their leader, on the leader's row."""

    def __init__(self, table: pa.Table, wildcard: str, wildcard_fact: dict | None) -> None:
        self.table, self.wildcard, self.fact = table, wildcard, wildcard_fact
        self.changed: list[np.ndarray] = []  # places among all tokens

    def block(self, codes: np.ndarray, starts: np.ndarray, nearest: np.ndarray) -> None:
        """``starts`` of the members' tokens among all; a place stays where all members agree."""
        others = np.flatnonzero(nearest != np.arange(len(nearest)))
        if len(others):
            member, place = np.nonzero(codes[others] != codes[nearest[others]])
            self.changed.append(starts[nearest[others[member]]] + place)

    def table_of(self, leader: np.ndarray) -> pa.Table:
        """All rows, those of leaders with what their group adds up to."""
        out, rows = self.table, len(leader)
        in_group = np.bincount(leader, minlength=rows)[leader] > 1
        if not in_group.any():
            return out
        kinds = {"known": "max", "cnt": "sum", "first_id": "min", "last_id": "max", "shapes": "sum"}
        groups = pa.table({"leader": leader, **{c: out[c] for c in kinds}}).filter(pa.array(in_group)).group_by(
            "leader").aggregate([(c, kind) for c, kind in kinds.items()])
        leads = np.zeros(rows, dtype=bool)
        leads[groups["leader"].to_numpy()] = True
        order = pc.sort_indices(groups["leader"])
        for c, kind in kinds.items():
            summed = groups[f"{c}_{kind}"].take(order).combine_chunks().cast(out.schema.field(c).type)
            made = pc.replace_with_mask(out[c].combine_chunks(), pa.array(leads), summed)
            out = out.set_column(out.schema.get_field_index(c), out.schema.field(c), made)
        if self.changed:
            at = np.unique(np.concatenate(self.changed))
            for c, value in (("tokens", self.wildcard), ("facts", self.fact)):
                if c in out.column_names:
                    lists = out[c].combine_chunks()
                    values = lists.flatten()
                    picked = np.arange(len(values))
                    picked[at] = len(values)
                    whole = pa.concat_arrays([values, pa.array([value], type=values.type)]).take(pa.array(picked))
                    ends = pa.array((lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32))
                    out = out.set_column(out.schema.get_field_index(c), out.schema.field(c),
                                         pa.ListArray.from_arrays(ends, whole, type=lists.type))
        return out


def leaders_in(table: pa.Table, options: MinerOptions, fold: Fold | None) -> np.ndarray:
    """The row of the leader of each row; the rows of whole blocks lie together."""
    blocks = pc.run_end_encode(table["block"].combine_chunks())
    ends = blocks.run_ends.to_numpy()
    sizes = np.diff(ends, prepend=0)
    leader = np.arange(table.num_rows)
    many = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if len(many):
        ranked = pa.table({"block": np.repeat(np.arange(len(sizes)), sizes)[many],
                           **{c: table[c].take(pa.array(many)) for c, _ in RANK}})
        order = many[pc.sort_indices(ranked, sort_keys=[("block", "ascending"), *RANK], null_placement="at_start").to_numpy()]
        values, starts = values_of(table["tokens"])
        codes, texts = numbered(values)
        wildcard = pc.index(texts, options.wildcard).as_py()
        n, th = table["n"].to_numpy(), table["_th"].to_numpy()
        vetoes = None
        if "facts" in table.column_names:
            facts, _ = values_of(table["facts"])
            heads, letters = numbered(facts.field("head"))
            nothing = pc.index(letters, "").as_py()
            marks = {t: i if i >= 0 else -10 for t, i in ((t, pc.index(texts, t).as_py()) for t in ("=", ":", ",", "."))}
            vetoes = Vetoes(codes, starts, pc.fill_null(facts.field("bits"), 0).to_numpy(),
                            np.where(heads == nothing, 0, heads + 1), marks, options)
        several = sizes[sizes > 1]
        for rows in np.split(order, np.cumsum(several)[:-1]):
            some = codes[starts[rows][:, None] + np.arange(n[rows[0]])]
            nearest = Block(some, some == wildcard, th[rows[0]], vetoes, rows).nearest()
            leader[rows] = rows[nearest]
            if fold is not None:
                fold.block(some, starts[rows], nearest)
    return leader


def nearest_in_whole(nodes: DataFrame, tokens: int, options: MinerOptions, folded: bool = False) -> DataFrame:
    """``nodes`` of blocks that are not ``too_large``, without ``block`` and with their
    ``leader_id``; ``tokens`` of all tells how many tasks they go to. With ``folded`` the rows
    of leaders hold the template of their group, see ``plans.mining``."""
    carried = [f for f in nodes.schema if f.name != "block"]
    fact = None
    if folded and "facts" in nodes.columns:
        fact = nodes.sparkSession.range(1).select(wildcard_fact(options).alias("f")).first()["f"].asDict()

    def found(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks()
        fold = Fold(table, options.wildcard, fact) if folded else None
        leader = leaders_in(table, options, fold)
        out = (fold.table_of(leader) if fold is not None else table).select([f.name for f in carried]).append_column(
            "leader_id", table["node_id"].combine_chunks().take(pa.array(leader)))
        yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += pc.sum(batch.column("n")).as_py() + batch.num_rows
            blocks = batch.column("block")
            if size > 4 * PIECE_TOKENS and (len(held) == 1 or blocks[0] != blocks[-1] or held[-2]["block"][-1] != blocks[0]):
                cut = pc.index(blocks, blocks[-1]).as_py()  # the last block may go on
                rest = held[-1].slice(cut)
                held[-1] = held[-1].slice(0, cut)
                if sum(t.num_rows for t in held):
                    yield from found(held)
                held, size = [rest], pc.sum(rest["n"]).as_py() + rest.num_rows
        if held:
            yield from found(held)

    schema = StructType([*carried, StructField("leader_id", StringType())])
    placed = nodes.withColumn("_th", S.threshold(F.col("n"), options.sim_th).cast("double")).repartition(
        max(1, tokens // PIECE_TOKENS), "block").sortWithinPartitions("block")
    return placed.mapInArrow(run, schema)
