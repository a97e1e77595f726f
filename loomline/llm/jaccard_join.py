"""N-gram Jaccard join (4): size-aware heavy-light join of shingle sets.

Two texts link if 100 * |A and B| >= percent * |A or B|, A and B their sets of
word shingles. Sets that are equal are one class from the start, so exact copies,
however many, are one set.

*Small sets* list subsets: for each size that a partner may have, all subsets of
the size that a link of those two sizes needs in common. Two small sets that link
share such a subset, and sets that share one link, so each subset's group is
joined to its smallest member without a comparison.

*Large sets* scan inverted lists, restricted to a prefix: in one order of all
shingles, sets that link share a shingle among the first n - ceil(0.9 n) + 1 of
each. Any order gives the same links; one that starts with rare shingles makes short
lists. ``counted``: by hash level, then by how many documents hold the shingle, where
only as many levels are counted as a prefix needs; right for narrow prefixes of short
shingles. Else shingles that repeat within batches of documents come last, by how often,
from a table of ``ORDER_BITS`` bits of hashes; right for wide prefixes, of which counting
would shuffle half the corpus, and for long shingles, which seldom repeat by chance. Short
lists make pairs, at most ``heavy`` squared a list. Members of long lists are dealt
to chunks with some pivots of their cluster in each, and a chunk is compared inside a
task as a product of incidence matrices, so near copies of one text become one
component by their pivots. What is in different components after that is dealt to
buckets of bounded size, and each pair of buckets that a list connects is compared,
unless both are of one component. Tasks return spanning forests of links, and all links
are verified by exact intersection sizes.

Before whole sets are shuffled, candidates meet by *parity maps*: a bit for each bucket of
hashes, about one bit a shingle, set where the bucket holds an odd number of shingles. A
shingle that only one of two sets holds changes one bit, so sets whose maps differ in more
bits than linked sets of their sizes may differ in shingles do not link, and no link is
lost. Only sets that may link by their maps are made whole.

The *boundary* between small and large minimises the estimated cost from the
histogram of sizes and the mean length of lists. Sets a little below the boundary
are in the index too, so pairs across it are found.

No key holds more than a bounded number of rows in a task: counts are combined
before the shuffle, joins have one row a key on one side and are split by the
planner, lists beyond ``heavy`` go to buckets. Shingles are 64-bit hashes (a
collision inside two documents would be needed to change a size); subsets are
keyed by 128 bits.

Defined results: null and empty texts have no shingles and link with nothing; a
text shorter than a shingle is one shingle; rows that repeat a doc_id are one
node; null ids get no component; other columns are not used.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.common import rows_at_once
from loomline.llm.components import connected_components, forest
from loomline.llm.phrase_mining import Rules, bit_set, joined_hash
from loomline.operators.ranking import top_per_group
from loomline.session import drop_shuffles, release, stage

SMALL_LIMIT = 29  # sets above this size have too many subsets to be worth listing
LEVELS = (0, 1, 2, 2, 3, 3, 3, 3)  # hash level of a shingle by its three highest bits
ORDER_BITS = 20  # size of the table of frequent shingles
PIVOTS, OWN_BUCKET = 16, 64  # pivots of a cluster; components from this size have buckets of their own
PAIRS_AT_ONCE = 128  # pairs of whole sets that a task is handed at once
BUCKET_SHINGLES = 2_000_000  # a bucket holds no more shingles than this, or one set


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, also used for the second half of set keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Distinct shingle hashes of a text in rising order."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    rows = len(words) - width + 1
    out = np.full(rows, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashed[k:k + rows] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    return np.unique(out)


def least_common(a: int, b: int, percent: int) -> int:
    """Fewest common members of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, least_common(n, m, percent)) for m in partner_sizes(n, percent))


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def parity_map(s: np.ndarray) -> bytes:
    """A bit for each bucket of hashes, as many as a power of two not below the set's size:
    whether an odd number of the set's shingles lies in it."""
    width = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(maps: list[bytes], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets that may link by their maps; a map is folded to meet a shorter one."""
    words = [np.frombuffer(m, dtype=np.uint64) for m in maps]
    widths = np.array([len(w) for w in words])
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for width in np.unique(widths):
        folds = [(k, np.flatnonzero(widths == width << k)) for k in range((100 // percent).bit_length() + 1)]
        at = np.concatenate([here for _, here in folds])
        table = np.array([np.bitwise_xor.reduce(words[i].reshape(1 << k, width), axis=0)
                          for k, here in folds for i in here])
        for k in range(len(folds[0][1])):
            total = sizes[at[k]] + sizes[at[k + 1:]]
            most = total - 2 * -(-percent * total // (100 + percent))
            near = np.flatnonzero(np.bitwise_count(table[k + 1:] ^ table[k]).sum(axis=1, dtype=np.int64) <= most)
            a.append(np.full(len(near), at[k]))
            b.append(at[k + 1 + near])
    return np.concatenate(a), np.concatenate(b)


def frequency_order(docs: DataFrame, size: int) -> np.ndarray:
    """A class of frequency for each bucket of shingle hashes; 0 where none repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                texts = whole.column(1).slice(at, 512).to_pylist()
                s, n = np.unique(np.concatenate([shingles(t, size) for t in texts]), return_counts=True)
                s, n = s[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)), pa.array(n, pa.int64())],
                    ["bucket", "f"])

    order = np.zeros(1 << ORDER_BITS, dtype=np.uint8)
    found = docs.mapInArrow(run, "bucket long, f long").groupBy("bucket").agg(
        F.least(F.floor(F.log2(F.sum("f")) * 4), F.lit(255)).cast("int").alias("class")).toArrow()
    order[found["bucket"].to_numpy()] = found["class"].to_numpy()
    return order


def signatures(docs: DataFrame, size: int, percent: int, order: np.ndarray) -> DataFrame:
    """``doc_id, n``, a 128-bit key of the set, its prefix in order, the whole set if it is
    small, and its parity map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, size)
                    n = len(s)
                    first = np.argsort(order[s >> np.uint64(64 - ORDER_BITS)], kind="stable")
                    prefix = s[first[:prefix_size(n, percent) if n else 0]]
                    out.append((n, int(s.sum(dtype=np.uint64).astype(np.int64)),
                                int(mix(s).sum(dtype=np.uint64).astype(np.int64)),
                                prefix.view(np.int64), s.tobytes() if n <= SMALL_LIMIT else None,
                                parity_map(s)))
                n, k1, k2, tokens, small, parity = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                     pa.array(k2, pa.int64()), pa.array(tokens, pa.list_(pa.int64())),
                     pa.array(small, pa.binary()), pa.array(parity, pa.binary())],
                    ["doc_id", "n", "k1", "k2", "tokens", "small", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, tokens array<long>, small binary, "
                                "parity binary")


def counted_signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """As ``signatures``, with the shingles of the levels that a prefix needs, in no order,
    and their number by level as ``emitted``."""
    levels = np.array(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, size)
                    n = len(s)
                    level = levels[(s >> np.uint64(61)).astype(np.int64)]
                    per_level = np.bincount(level, minlength=4)
                    need = prefix_size(n, percent) if n else 0
                    last = int(np.searchsorted(np.cumsum(per_level), need))
                    per_level[last + 1:] = 0
                    out.append((n, int(s.sum(dtype=np.uint64).astype(np.int64)),
                                int(mix(s).sum(dtype=np.uint64).astype(np.int64)),
                                s[:int(per_level.sum())].view(np.int64), per_level.tolist(),
                                s.tobytes() if n <= SMALL_LIMIT else None, parity_map(s)))
                n, k1, k2, tokens, per_level, small, parity = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                     pa.array(k2, pa.int64()), pa.array(tokens, pa.list_(pa.int64())),
                     pa.array(per_level, pa.list_(pa.int32())), pa.array(small, pa.binary()),
                     pa.array(parity, pa.binary())],
                    ["doc_id", "n", "k1", "k2", "tokens", "emitted", "small", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, tokens array<long>, "
                                "emitted array<int>, small binary, parity binary")


def choose_boundary(sets: DataFrame, percent: int, scan_weight: float = 8.0) -> int:
    """The largest size treated as small, by estimated cost of either way."""
    small = sets.filter(f"n BETWEEN 1 AND {SMALL_LIMIT}")
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    lists = small.select(F.explode("tokens").alias("t")).agg(
        F.count("*").alias("rows"), F.approx_count_distinct("t").alias("lists")).first()
    length = lists["rows"] / max(lists["lists"], 1)
    costs = {}
    for x in range(SMALL_LIMIT + 1):
        listed = sum(c * subset_count(n, percent) for n, c in sizes.items() if n <= x)
        scanned = sum(c * prefix_size(n, percent) * (1 + scan_weight * (length - 1))
                      for n, c in sizes.items() if n > x)
        costs[x] = listed + scanned
    return min(costs, key=lambda x: (costs[x], x))


def small_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """``(a, b)``: small sets with the smallest member of each subset they share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = np.frombuffer(raw, dtype=np.uint64)
                    t = mix(s)
                    n, all_s, all_t = len(s), s.sum(dtype=np.uint64), t.sum(dtype=np.uint64)
                    for m in partner_sizes(n, percent):
                        if m > boundary:
                            continue
                        for gone in itertools.combinations(range(n), n - least_common(n, m, percent)):
                            g = list(gone)
                            rows.append((min(n, m), max(n, m),
                                         int((all_s - s[g].sum(dtype=np.uint64)).astype(np.int64)),
                                         int((all_t - t[g].sum(dtype=np.uint64)).astype(np.int64)),
                                         n, doc))
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["lo", "hi", "s1", "s2", "n", "doc"])

    key = ["lo", "hi", "s1", "s2"]
    listed = stage(sets.filter(F.col("n").between(1, boundary)).select("doc_id", "small").mapInArrow(
        run, "lo long, hi long, s1 long, s2 long, n long, doc long"), "subsets")
    heads = stage(listed.groupBy(*key).agg(
        F.min("doc").alias("head"), F.max("doc").alias("tail"), F.min("n").alias("n1"),
        F.max("n").alias("n2"))
        .filter("head < tail AND n1 = lo AND n2 = hi").select(*key, "head"), "subsets")
    return listed.join(heads, key).filter("doc != head").select(
        F.col("doc").alias("a"), F.col("head").alias("b"))


def prefix_index(sets: DataFrame, least_size: int, percent: int) -> DataFrame:
    """``(token, doc, n, pos, first)``: shingles of each prefix that other sets hold too.

    ``pos`` is how many shingles of the set come before it, so a partner whose first
    common shingle it is has at most ``n - pos`` in common. ``first``: that is enough
    for a partner of the same size. Of two sets that link, the smaller holds a common
    shingle of both prefixes in its ``first`` part.
    """
    tokens = sets.filter(F.col("n") >= least_size).select(
        F.col("doc_id").alias("doc"), "n", F.posexplode("tokens").alias("pos", "token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token"), "lists")
    return tokens.join(shared, "token").select("token", "doc", "n", F.col("pos").cast("long").alias("pos")).withColumn(
        "first", F.col("n") - F.col("pos") >= needed(F.col("n"), F.col("n"), percent))


def counted_index(sets: DataFrame, least_size: int, percent: int) -> DataFrame:
    """As ``prefix_index``, of ``counted_signatures``: counts what prefixes may need."""
    able = sets.filter(F.col("n") >= least_size)
    tokens = able.select("doc_id", F.explode("tokens").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "lists")
    known = tokens.join(shared, "token").groupBy("doc_id").agg(
        F.collect_list(F.struct("df", "token")).alias("listed"))
    levels = np.array(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes, emitted, listed = (batch.column(i) for i in range(4))
            out_doc, out_n, out_token, out_pos = [], [], [], []
            for doc, n, per_level, rows in zip(docs.to_pylist(), sizes.to_pylist(),
                                               emitted.to_pylist(), listed):
                df = rows.values.field("df").to_numpy(zero_copy_only=False)
                token = rows.values.field("token").to_numpy(zero_copy_only=False)
                level = levels[(token.view(np.uint64) >> np.uint64(61)).astype(np.int64)]
                order = np.lexsort((token, df, level))
                room, passed = prefix_size(n, percent), 0
                for at in range(4):
                    here = order[level[order] == at]
                    passed += per_level[at] - len(here)  # shingles of no other set come first
                    if passed >= room:
                        break
                    taken = here[:room - passed]
                    out_pos.append(np.arange(passed, passed + len(taken)))
                    passed += len(taken)
                    out_token.append(token[taken])
                    out_doc.append(np.full(len(taken), doc, dtype=np.int64))
                    out_n.append(np.full(len(taken), n, dtype=np.int64))
            if out_token:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(c), pa.int64()) for c in (out_token, out_doc, out_n)),
                     pa.array(np.concatenate(out_pos), pa.int64())], ["token", "doc", "n", "pos"])

    rows = known.join(able.select("doc_id", "n", "emitted"), "doc_id").select(
        "doc_id", "n", "emitted", "listed")
    return rows.mapInArrow(run, "token long, doc long, n long, pos long").withColumn(
        "first", F.col("n") - F.col("pos") >= needed(F.col("n"), F.col("n"), percent))


def needed(a: Column, b: Column, percent: int) -> Column:
    """``least_common`` of two sizes."""
    return F.floor(((a + b) * percent + (100 + percent - 1)) / (100 + percent))


def common_of(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(doc, set)`` of the documents in ``ids(doc_id)``, and of a few more: tasks know the
    ids by a bit set of fixed size, so texts are not shuffled to meet them."""
    asked, _ = bit_set(ids, ["doc_id"], Rules())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                known = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                batch = batch.filter(pa.array(asked.holds(joined_hash([known]))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([shingles(t, size).tobytes() for t in
                                                batch.column(1).to_pylist()], pa.binary())],
                    ["doc", "set"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc long, set binary")


def light_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of the members of short lists."""
    grouped = lists.groupBy("token").agg(F.sort_array(F.collect_list(
        F.struct("n", "pos", "doc"))).alias("m"))

    def may_link(x: Column, y: Column) -> Column:
        least = needed(x["n"], y["n"], percent)
        return (x["n"] - x["pos"] >= least) & (y["n"] - y["pos"] >= least)

    # In order of size, so that x is the smaller one.
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.size("m")), lambda y: (x["n"] * 100 >= y["n"] * percent)
                 & may_link(x, y) & (x["doc"] != y["doc"])),
        lambda y: F.struct(F.least(x["doc"], y["doc"]).alias("a"),
                           F.greatest(x["doc"], y["doc"]).alias("b")))))
    return grouped.select(F.inline(pairs)).distinct()


def close_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their maps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in (2, 3)]
            x, y = (batch.column(c).to_pylist() for c in (4, 5))
            keep = [len(may_link([x[i], y[i]], np.array([sizes[0][i], sizes[1][i]]), percent)[0]) > 0
                    for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = maps.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    right = maps.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(
        run, "a long, b long")


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
                common = common_of(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(side, keep) if k], pa.int64()) for side in (a, b)], ["a", "b"])

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        run, "a long, b long")


Sets = Callable[[DataFrame], DataFrame]  # the whole sets ``(doc, set)`` of ids, and of a few more


def maps_of(sets: DataFrame) -> DataFrame:
    """``(doc, n, parity)`` of whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.frombuffer(s, dtype=np.uint64) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in some], pa.int64()),
                 pa.array([parity_map(s) for s in some], pa.binary())], ["doc", "n", "parity"])

    return sets.select("doc", "set").mapInArrow(run, "doc long, n long, parity binary")


def heavy_links(lists: DataFrame, sets: DataFrame | Sets, percent: int, bucket: int,
                maps: DataFrame | None = None) -> DataFrame:
    """Links between members of long lists, enough of them to connect what links.

    ``sets`` holds the whole sets, or makes them of ids, then with ``maps(doc, n, parity)``.

    Lists that share members are one cluster (the shingles of a common passage, say).
    First the members of a cluster are compared in chunks that its pivots join, then
    those that lie in different components, in buckets of like size.
    """
    of: Sets = sets if maps is not None else lambda ids: sets
    maps = maps if maps is not None else stage(maps_of(sets), "maps")
    held = stage(held_lists(lists), "held")
    clusters = connected_components(held.select(F.explode("tokens").alias("a"), F.array_min("tokens").alias("b")))
    homes = stage(held.select("doc", "n", F.array_min("tokens").alias("token")).join(clusters.withColumnRenamed("node", "token"), "token", "left").select(
        "doc", "n", F.coalesce("component", "token").alias("home")), "homes")
    drop_shuffles(lists.sparkSession)
    near = stage(chunk_links(homes, of, maps, percent, bucket), "near")
    drop_shuffles(lists.sparkSession)
    far = stage(bucket_links(homes, held, of, maps, near, percent, bucket), "far")
    release(homes, held)
    return near.unionByName(far)


def held_lists(lists: DataFrame) -> DataFrame:
    """``(doc, n, tokens, places)``: the lists that a member is in, at most its prefix; what a member is
    joined with meets one row of it, however many lists it shares with its like.

    ``places`` are the ``pos`` of the lists; without that column a list may be the first of each set.
    """
    pos = F.col("pos") if "pos" in lists.columns else F.lit(0).cast("long")
    listed = lists.groupBy("doc", "n").agg(F.collect_list(F.struct("token", pos.alias("pos"))).alias("listed"))
    return listed.select("doc", "n", F.col("listed.token").alias("tokens"), F.col("listed.pos").alias("places"))


def largest_partner(n: Column, pos: Column, percent: int) -> Column:
    """Size of the largest set that links with one of ``n`` if the first shingle both hold has
    ``pos`` of its own before it, so that no more than ``n - pos`` are common."""
    return F.least(F.floor(n * 100 / percent), F.floor((n - pos) * (100 + percent) / percent) - n)


def chunk_links(homes: DataFrame, sets: Sets, maps: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links inside chunks of a cluster; the pivots of the cluster are in each chunk."""
    pivots = stage(top_per_group(homes, ["home"], [F.xxhash64("doc"), F.col("doc")], PIVOTS, F.col("doc"))
                   .select("home", "doc"), "pivots")
    sizes = homes.groupBy("home").agg(F.greatest(
        F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / BUCKET_SHINGLES)).cast("int").alias("parts"))
    parts = stage(sizes, "parts")
    own = homes.join(parts, "home").select(
        "home", "doc", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int").alias("part"))
    shown = pivots.join(parts.filter("parts > 1"), "home").select(
        "home", "doc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = own.unionByName(shown).distinct().join(maps, "doc")
    able = stage(rows.groupBy("home", "part").applyInPandas(
        lambda pdf: able_rows(pdf, percent)[["home", "part", "doc"]], "home long, part int, doc long"), "able")
    drop_shuffles(homes.sparkSession)
    return able.join(sets(able.select("doc")), "doc").groupBy("home", "part").applyInPandas(
        lambda pdf: linked_rows(pdf, percent), "a long, b long")


def able_rows(pdf: pd.DataFrame, percent: int, sides: str | None = None) -> pd.DataFrame:
    """The rows of a group that may link with another of them by their maps; with ``sides``
    with one that differs in it."""
    a, b = may_link(list(pdf["parity"]), pdf["n"].to_numpy(), percent)
    if sides is not None:
        across = pdf[sides].to_numpy()[a] != pdf[sides].to_numpy()[b]
        a, b = a[across], b[across]
    return pdf.iloc[np.unique(np.r_[a, b])]


def linked_rows(pdf: pd.DataFrame, percent: int, sides: str | None = None) -> pd.DataFrame:
    """A spanning forest of the links of a group's rows; with ``sides`` of those between
    rows that differ in it."""
    pdf = pdf.sort_values("doc", kind="stable").reset_index(drop=True)
    a, b = linked_in_block([np.frombuffer(s, dtype=np.uint64) for s in pdf["set"]], percent)
    if sides is not None:
        across = pdf[sides].to_numpy()[a] != pdf[sides].to_numpy()[b]
        a, b = a[across], b[across]
    root = forest(a, b, len(pdf))
    docs, moved = pdf["doc"].to_numpy(), root != np.arange(len(pdf))
    return pd.DataFrame({"a": docs[moved], "b": docs[root[moved]]})


def bucket_links(homes: DataFrame, held: DataFrame, sets: Sets, maps: DataFrame, near: DataFrame,
                 percent: int, bucket: int) -> DataFrame:
    """Links between components that a list connects, by pairs of buckets."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    joined = connected_components(near)
    # Of two sets that link, the smaller leads: a list lets it meet sets of its own size and above.
    leads = held.select("doc", (largest_partner(F.col("n"), F.array_min("places"), percent) >= F.col("n")).alias("leads"))
    known = stage(homes.join(joined.withColumnRenamed("node", "doc"), "doc", "left").join(leads, "doc").select(
        "doc", "n", "home", size_class.alias("class"), "leads", F.coalesce("component", "doc").alias("component")), "known")
    large = stage(known.groupBy("component").count().filter(F.col("count") >= OWN_BUCKET).select(
        "component", F.col("component").alias("own")), "large")
    placed = known.join(large, "component", "left")
    kind = ["home", "class", "leads", "own"]
    counts = stage(placed.groupBy(*kind).agg(F.greatest(
        F.ceil(F.count("*") / bucket), F.ceil(F.sum("n") / BUCKET_SHINGLES)).cast("int").alias("parts")), "counts")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in kind]
    members = stage(placed.alias("p").join(counts.alias("c"), same).select(
        "doc", "n", "component", "p.own", F.xxhash64("p.home", "p.class", "p.leads", F.coalesce("p.own", F.lit(-1)),
                                                     F.col("p.own").isNull(), part).alias("bucket")), "members")
    spread = stage(held.select("doc", "tokens", "places").join(members.select("doc", "n", "own", "bucket"), "doc").select(
        "doc", "n", "own", "bucket", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("pos"))))
        .withColumn("most", largest_partner(F.col("n"), F.col("pos"), percent)).drop("pos"), "spread")
    # The members of a list inside a bucket, a bounded number, are one row.
    met = stage(spread.groupBy("token", "bucket").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("most").alias("most"), F.min("own").alias("own"),
        F.collect_list(F.struct("doc", "n", "most")).alias("members")), "met")

    def reach(n: Column, most: Column, lo: Column, hi: Column) -> Column:
        """Whether some size from ``lo`` to ``hi`` is neither too small for sets of ``n`` nor above ``most``."""
        return (hi * 100 >= n * percent) & (lo <= most)

    other = met.select("token", F.col("bucket").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"),
                       F.col("most").alias("other_most"), F.col("own").alias("other_own"))
    # A set goes only to the pairs of buckets where one of its own lists may let it link.
    going = F.transform(F.filter("members", lambda m: reach(m["n"], m["most"], F.col("other_lo"), F.col("other_hi"))
                                 & reach(F.col("other_lo"), F.col("other_most"), m["n"], m["n"])), lambda m: m["doc"])
    pairs = stage(met.join(other, "token").filter(
        reach(F.col("lo"), F.col("most"), F.col("other_lo"), F.col("other_hi"))
        & reach(F.col("other_lo"), F.col("other_most"), F.col("lo"), F.col("hi"))
        & ~F.coalesce(F.col("own") == F.col("other_own"), F.lit(False)))
        .select(F.least("bucket", "other").alias("i"), F.greatest("bucket", "other").alias("j"), going.alias("docs")), "pairs")
    sided = stage(pairs.groupBy("i", "j").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
                  .select("i", "j", F.explode("docs").alias("doc")), "sided")
    release(met, pairs, spread)
    drop_shuffles(homes.sparkSession)
    rows = sided.join(members.select("doc", "component").join(maps, "doc"), "doc")
    able = stage(rows.groupBy("i", "j").applyInPandas(
        lambda pdf: able_rows(pdf, percent, "component")[["i", "j", "doc", "component"]],
        "i long, j long, doc long, component long"), "able")
    release(sided)
    drop_shuffles(homes.sparkSession)
    return able.join(sets(able.select("doc")), "doc").groupBy("i", "j").applyInPandas(
        lambda pdf: linked_rows(pdf, percent, "component"), "a long, b long")


def linked_in_block(sets: list[np.ndarray], percent: int, columns: int = 4096
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets that link, from common counts by matrix products over
    the shingles that two or more of them hold."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, at = owner[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(at, (start, start + columns))
        block = np.zeros((len(sets), columns), dtype=np.float32)
        block[owner[lo:hi], at[lo:hi] - start] = 1.0
        common += block @ block.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (common > 0)
    return np.nonzero(np.triu(linked, 1))


def join_similar(docs: DataFrame, percent: int = 90, size: int = 3, heavy: int = 32,
                 bucket: int = 256, counted: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of each row of ``docs``; the class
    is the smallest id with the same set."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    signed = stage(counted_signatures(texts, size, percent) if counted else signatures(
        texts, size, percent, frequency_order(texts, size)), "signatures")
    named = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")
    sets = stage(named.join(classes.select(F.col("class_id").alias("doc_id"), "n", "k1", "k2"),
                            ["doc_id", "n", "k1", "k2"], "left_semi")
                 .drop("k1", "k2"), "sets")
    every_map = stage(sets.select(F.col("doc_id").alias("doc"), "n", "parity"), "maps")

    # What is left to read of the signatures is slim; their shingles go once they are used.
    slim = stage(signed.select("doc_id", "n", "k1", "k2"), "slim")
    release(signed)
    boundary = choose_boundary(sets, percent)
    edges = [stage(small_links(sets, boundary, percent), "edges")] if boundary else []
    least_size = -(-percent * (boundary + 1) // 100)
    index = stage((counted_index if counted else prefix_index)(sets, least_size, percent), "index")
    release(sets)
    drop_shuffles(spark)
    # A list needs a member of a first part; larger sets meet it with their whole prefix.
    least_first = stage(index.groupBy("token").agg(
        F.min(F.when(F.col("first"), F.col("n"))).alias("least"), F.count("*").alias("len"))
        .filter("len > 1 AND least IS NOT NULL").select("token", "least"), "lengths")
    able = stage(index.join(least_first, "token").filter(
        F.col("first") | (F.col("n") > F.col("least"))).drop("least"), "lists")
    lengths = stage(able.groupBy("token").agg(F.count("*").alias("len")).filter("len > 1"), "lengths")
    lists = stage(able.join(lengths, "token"), "lists")
    release(index, able, least_first, lengths)
    drop_shuffles(spark)
    short, long_ = lists.filter(F.col("len") <= heavy), lists.filter(F.col("len") > heavy)
    pairs = stage(light_pairs(short, percent), "pairs")
    wholes: list[DataFrame] = []

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")).alias("doc"))

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = stage(ids.select(F.col("doc").alias("doc_id")).distinct(), "ids")
        wholes.append(stage(whole_sets(texts, asked, size), "wholes"))
        release(asked)
        return wholes[-1]

    asked = ends(pairs).unionByName(long_.select("doc")).distinct()
    maps = stage(every_map.join(asked, "doc"), "maps")
    release(every_map)
    close = stage(close_pairs(pairs, maps, percent), "close")
    release(pairs)
    full = sets_of(ends(close))
    with rows_at_once(spark, PAIRS_AT_ONCE):
        edges.append(stage(verified_pairs(close, full, percent), "edges"))
    release(close, full)
    drop_shuffles(spark)
    edges.append(heavy_links(long_, sets_of, percent, bucket, maps))
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    links = stage(links.distinct(), "links")
    release(lists, maps, *wholes[1:], *edges[:-1])
    drop_shuffles(spark)
    components = connected_components(links)
    out = slim.join(classes, ["n", "k1", "k2"], "left").join(
        components.withColumnRenamed("node", "class_id"), "class_id", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", class_id)).alias("component_id"),
        class_id.alias("class_id"))
