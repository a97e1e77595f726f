"""Embedding near-dedup (1): random projections decoded to E8 lattice points.

A table projects a unit vector to ``blocks`` times eight dimensions and decodes
each block to the nearest point of the E8 lattice; the nearest neighbours of that
point (its ``probes`` closest of the 240 minimal vectors) are probed too, so a
vector stands in several cells a table, and two vectors meet in a table if they
share a cell. Pairs that meet in any table are compared by cosine in double
precision; only those that reach the threshold are links.

Groups of copies do not make pairs. First every vector looks for a *pivot* in the
cells of a coarser table and joins the first one within half the threshold angle;
by the triangle inequality all vectors of a pivot are linked with each other, so
they are counted, not compared. What is left are links between different pivots'
groups: only cells that hold two groups or more are kept, dealt in chunks of
bounded size, a task comparing two chunks at a time by matrix product. It counts
a link in the first cell that the pair shares and returns one count per vector
and a spanning forest, never the pairs.

Memory per task is two chunks. Defined results: null, empty or zero vectors and
vectors with null or non-finite components link with nothing and are kept; rows
that repeat a vec_id are one vector (the largest); vectors of different lengths
never link; null ids are dropped from linking and returned as they are; other
columns are not used.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.components import connected_components, forest
from loomline.session import stage


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(h) for h in itertools.product((0.5, -0.5), repeat=8)
            if sum(x < 0 for x in h) % 2 == 0]
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are integers of even sum."""
    whole = np.rint(x)
    off = x - whole
    odd = np.flatnonzero(whole.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the integer and the half-integer coset."""
    a = nearest_d8(x)
    b = nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class Cells:
    """Cells of unit vectors of one dimension in all tables, as 64-bit hashes."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int
                 ) -> None:
        rng = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.project = rng.normal(size=(dim, tables * blocks * 8)) * scale
        self.mark = rng.integers(-2 ** 62, 2 ** 62, size=(tables, blocks * 8))
        self.roots = minimal_vectors()

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """An array (vectors, tables, cells of a table), cells in rising order."""
        y = unit @ self.project
        out = []
        for t in range(self.tables):
            sums = None
            for b in range(self.blocks):
                at = (t * self.blocks + b) * 8
                x = y[:, at:at + 8]
                point = nearest_e8(x)
                near = np.argsort(-((x - point) @ self.roots.T), axis=1, kind="stable")[:, :self.probes]
                points = np.concatenate([point[:, None], point[:, None] + self.roots[near]], axis=1)
                whole = np.rint(points * 2).astype(np.int64)
                hashed = (whole * self.mark[t, b * 8:b * 8 + 8]).sum(axis=2)
                sums = hashed if sums is None else (
                    sums[:, :, None] + hashed[:, None, :]).reshape(len(unit), -1)
            out.append(np.sort(sums, axis=1))
        return np.stack(out, axis=1)


def usable(vector: list | None) -> bool:
    if not vector or any(v is None for v in vector):
        return False
    norm = math.hypot(*vector)
    return math.isfinite(norm) and norm > 0


def units(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def code_vectors(vectors: DataFrame, tables: int, blocks: int, probes: int, scale: float,
                 coarse_probes: int, seed: int) -> DataFrame:
    """``(id, vec, cells, coarse)`` of the usable vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, tuple[Cells, Cells]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                by_dim: dict[int, list[tuple[int, list]]] = {}
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if usable(v):
                        by_dim.setdefault(len(v), []).append((i, v))
                for dim, rows in by_dim.items():
                    if dim not in coders:
                        coders[dim] = (Cells(dim, tables, blocks, probes, scale, seed),
                                       Cells(dim, 1, 1, coarse_probes, scale, seed + 1))
                    unit = units([v for _, v in rows])
                    fine, coarse = (c(unit).reshape(len(rows), -1) for c in coders[dim])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in rows], pa.int64()),
                         pa.array(list(unit), pa.list_(pa.float64())),
                         pa.array(list(fine), pa.list_(pa.int64())),
                         pa.array(list(coarse), pa.list_(pa.int64()))],
                        ["id", "vec", "cells", "coarse"])

    return vectors.mapInArrow(
        run, "id long, vec array<double>, cells array<long>, coarse array<long>")


def group_by_pivots(coded: DataFrame, threshold: float) -> DataFrame:
    """``(id, core)``: vectors of one core are all linked with each other. A vector
    looks at the first pivot of each of its coarse cells and takes the first of those
    within half the angle of the threshold; without one it is its own core."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    placed = coded.select("id", "vec", F.explode(F.array_distinct("coarse")).alias("cell"))
    ranked = F.struct(F.xxhash64("id").alias("turn"), F.col("id").alias("pivot"))
    pivots = stage(placed.groupBy("cell").agg(F.min(ranked).alias("first"), F.count("*").alias("n"))
                   .filter("n > 1").select("cell", "first.turn", "first.pivot"), "pivots")
    shown = stage(coded.select(F.col("id").alias("pivot"), F.col("vec").alias("pivot_vec")).join(
        pivots, "pivot"), "pivots")
    cosine = F.aggregate(F.zip_with("vec", "pivot_vec", lambda x, y: x * y), F.lit(0.0),
                         lambda s, x: s + x)
    same_length = F.size("vec") == F.size("pivot_vec")
    near = placed.join(shown, "cell").filter(same_length).filter(cosine >= half)
    return near.groupBy("id").agg(F.min(F.struct("turn", "pivot")).alias("best")).select(
        "id", F.col("best.pivot").alias("core"))


def link_counts(coded: DataFrame, cores: DataFrame, threshold: float, tables: int, chunk: int
                ) -> DataFrame:
    """Links between cores: ``(id, n, root)`` from each pair of chunks, to be summed;
    ``id`` and ``root`` are in one component."""
    full = stage(coded.drop("coarse").join(cores, "id"), "vectors")
    width = F.size("cells") / tables
    cells = full.select("id", "core", F.posexplode("cells").alias("at", "cell"),
                        width.cast("int").alias("width")).select(
        "id", "core", F.floor(F.col("at") / F.col("width")).cast("int").alias("tab"), "cell").distinct()
    crowded = stage(cells.groupBy("tab", "cell").agg(
        F.min("core").alias("lo"), F.max("core").alias("hi"), F.count("*").alias("n"))
        .filter("lo != hi").select("tab", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")),
        "cells")
    own = F.pmod(F.xxhash64("id", "tab"), F.col("chunks")).cast("int")
    dealt = cells.join(crowded, ["tab", "cell"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "id", "tab", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own")
    group = ["tab", "cell", "i", "j"]
    rows = dealt.join(full, "id").select(
        *group, "own", "id", "core", F.size("vec").alias("dim"), "vec", "cells")
    # Most cells hold two or three vectors: a partition is sorted by group and compared in
    # runs of whole groups, not called group by group.
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "dim", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            held = some if held is None else pa.concat_tables([held, some])
            key = _keys(held)
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (
                (key != key[-1]).any()) else 0
            if last:
                yield _compare(held.slice(0, last), threshold, tables)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield _compare(held, threshold, tables)

    return ordered.mapInArrow(run, "id long, n long, root long")


def _keys(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in ("tab", "cell", "i", "j", "dim")], axis=1)


def _compare(rows: pa.Table, threshold: float, tables: int) -> pa.RecordBatch:
    """Links of whole groups, sorted by group: counts and a forest of links by vector."""
    key = _keys(rows)
    ids, core, own = (rows.column(c).to_numpy() for c in ("id", "core", "own"))
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    lists = [rows.column(c).combine_chunks() for c in ("vec", "cells")]
    flat = [x.flatten().to_numpy() for x in lists]
    begin = [np.r_[0, np.cumsum(x.value_lengths().to_numpy())] for x in lists]
    across = key[:, 2] != key[:, 3]
    left, right = [], []
    for d in range(1, int(np.bincount(group).max(initial=1))):
        a = np.flatnonzero(group[:-d] == group[d:])
        b = a + d
        use = (core[a] != core[b]) & (~across[a] | (own[a] != own[b]))
        a, b = a[use], b[use]
        for at in range(0, len(a), 8192):
            x, y = a[at:at + 8192], b[at:at + 8192]
            for dim in np.unique(key[x, 4]):
                p, q = x[key[x, 4] == dim], y[key[x, 4] == dim]
                steps = np.arange(dim)
                cosine = (flat[0][begin[0][p][:, None] + steps] * flat[0][begin[0][q][:, None] + steps]).sum(axis=1)
                left.append(p[cosine >= threshold])
                right.append(q[cosine >= threshold])
    a = np.concatenate(left) if left else np.empty(0, dtype=np.int64)
    b = np.concatenate(right) if right else np.empty(0, dtype=np.int64)
    root = forest(a, b, len(ids))
    counts = np.zeros(len(ids), dtype=np.int64)
    width = int(begin[1][1]) // tables if len(ids) else 0
    for at in range(0, len(a), 20_000):
        p, q = a[at:at + 20_000], b[at:at + 20_000]
        first = np.ones(len(p), dtype=bool)
        for t in range(tables):
            steps = np.arange(t * width, (t + 1) * width)
            mine = flat[1][begin[1][p][:, None] + steps]
            common = mine[:, :, None] == flat[1][begin[1][q][:, None] + steps][:, None, :]
            # Cells are in rising order: the first common one is the smallest.
            smallest = np.where(common.any(axis=2), mine, np.iinfo(np.int64).max).min(axis=1)
            first &= np.where(key[p, 0] > t, ~common.any(axis=(1, 2)),
                              (key[p, 0] < t) | (smallest == key[p, 1]))
        counts += np.bincount(p[first], minlength=len(ids))
        counts += np.bincount(q[first], minlength=len(ids))
    said = (counts > 0) | (root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[said]), pa.array(counts[said]), pa.array(ids[root[said]])], ["id", "n", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int = 4, blocks: int = 2,
                    probes: int = 2, scale: float = 0.65, coarse_probes: int = 3, chunk: int = 256,
                    seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept, core_size`` of every vector."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vec_col).cast("array<double>").alias("vec"))
    known = given.filter("id IS NOT NULL").groupBy("id").agg(F.max("vec").alias("vec"))
    coded = stage(code_vectors(known, tables, blocks, probes, scale, coarse_probes, seed), "codes")
    found = group_by_pivots(coded, threshold)
    cores = stage(coded.select("id").join(found, "id", "left").select(
        "id", F.coalesce("core", "id").alias("core")), "cores")
    sizes = cores.groupBy("core").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    counted = stage(link_counts(coded, cores, threshold, tables, chunk), "links")
    members = stage(cores.join(stage(sizes, "sizes"), "core"), "members")
    edges = members.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(
        counted.select(F.col("id").alias("a"), F.col("root").alias("b")))
    components = connected_components(edges)
    across = counted.groupBy("id").agg(F.sum("n").alias("n"))
    out = given.select("id").distinct().join(members, "id", "left").join(across, "id", "left").join(
        components.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
        F.coalesce("size", F.lit(1)).alias("core_size"))
