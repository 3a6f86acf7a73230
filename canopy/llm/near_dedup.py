"""Near-duplicate classes by ProbMinHash, banding and verification.

Documents are bags of shingles of SHINGLE words (lower case, letters and digits); a shingle weighs as often
as it occurs. Each shingle sends exponential arrivals at a rate of its weight to random registers; a
register keeps the shingle that came first. A document stops drawing arrivals at the time by which all
its registers are filled (early termination). The share of equal registers of two documents estimates
their probability Jaccard similarity. BANDS bands of ROWS registers are hashed to buckets; a pair at
similarity 0.8 misses all of them with a chance of 3.2e-5. Pairs are verified by the exact probability
Jaccard of the whole texts (plain Jaccard where no shingle is repeated), of at least THRESHOLD.

Exact copies (equal word sequences) become one node first, whatever their number, and buckets with the same
nodes become one. Then every two nodes of a bucket that are not in one class already are compared, in two steps:

1. Each node is compared with the leader of its bucket, the node that meets most others over all its
   buckets; in a group of copies this is their original, so that a group of n copies costs n comparisons. The texts
   that a leader is compared with stream past it, spread over tasks by their bytes.
2. In buckets that still hold several classes, the nodes are dealt over blocks of about BLOCK_BYTES of text, a
   class larger than that over blocks of its own, and each two blocks meet once unless both are of one class. Inside
   two blocks a prefix filter finds the pairs: ordered from rare to frequent, shingles with less than the threshold of a
   text's weight behind them must hold one that both texts have. It is exact, so no link in a bucket is lost, and
   texts that share a long passage do not meet through the passage. What grows with the square of a bucket without
   classes is the shipping of its texts, divided by the size of a block.

Classes are connected components: partitions contract their links first, then alternating large-star and
small-star steps over checkpointed links; links and labels never leave the executors.

Cases: a text with fewer than SHINGLE words is one shingle; a null or wordless text is a class by itself;
the class id is the smallest doc_id of the class (null only if all are null); repeated rows are exact
copies; a text of any length is compared whole; an empty table gives no rows; other columns are not looked at, and
representatives() keeps them whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import checkpointed, small_batches, text_blocks, unused

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 34, 6
REGISTERS = BANDS * ROWS
#: Text bytes of a block of nodes, and of what one task compares with a leader.
BLOCK_BYTES = 8 << 20
#: Rows of numbers, and bytes of text, that are worth a partition of their own.
ROWS_A_TASK, BYTES_A_TASK = 100_000, 16 << 20
#: Links that a partition contracts at a time.
CONTRACTED = 400_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE_HASH = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix)."""
    x = (x ^ (x >> _SHIFTS[0])) * _MIX[0]
    x = (x ^ (x >> _SHIFTS[1])) * _MIX[1]
    return x ^ (x >> _SHIFTS[2])


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(self.base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def _range_hashes(values: np.ndarray, begins: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """Hash of each range of values, which depends on the values in the range and their order alone."""
    up, down = _POWERS[which].get(len(values))
    sums = np.r_[np.uint64(0), np.cumsum(values * up[: len(values)], dtype=np.uint64)]
    return mix((sums[stops] - sums[begins]) * down[begins])


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of lower-cased texts, words before each row)."""
    inside = _WORD[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    begins = np.flatnonzero(inside & (fresh[:-1] | ~np.r_[False, inside[:-1]]))
    stops = np.flatnonzero(inside & (fresh[1:] | ~np.r_[inside[1:], False])) + 1
    return _range_hashes(_BYTE_HASH[data], begins, stops, 0), np.searchsorted(begins, offsets)


def shingle_bags(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of each distinct shingle of each row, by row and shingle."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    rows = np.repeat(np.arange(len(sizes)), counts)
    begins = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[rows]
    hashes = _range_hashes(words, begins, np.minimum(begins + SHINGLE, bounds[rows + 1]), 1)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], hashes[first], np.diff(np.r_[first, len(rows)])


def registers(rows: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that each of the m registers of each row keeps; rows without shingles keep 0."""
    kept = np.zeros(n * m, np.uint64)
    weights = np.bincount(rows, counts, minlength=n)
    wait = m * (np.log(m) + 3) / np.maximum(weights, 1)
    todo = np.arange(len(rows))
    while len(todo):
        # all arrivals up to each row's stopping time
        seed, rate, stop, base = shingles[todo], 1.0 / counts[todo], wait[rows[todo]], rows[todo] * m
        time, turn = np.zeros(len(todo)), 0
        targets, times, senders = [], [], []
        while len(seed):
            draw = mix(seed + np.uint64((turn * _STEP) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(24)).astype(np.float64) + 1) * 2.0**-40) * rate
            on = np.flatnonzero(time <= stop)
            seed, rate, stop, base, time = seed[on], rate[on], stop[on], base[on], time[on]
            pick = ((draw[on] & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
            targets.append(base + pick.astype(np.int64))
            times.append(time)
            senders.append(seed)
            turn += 1
        target, time, sender = np.concatenate(targets), np.concatenate(times), np.concatenate(senders)
        soonest = np.full(n * m, np.inf)
        np.minimum.at(soonest, target, time)
        won = np.flatnonzero(time == soonest[target])
        kept[target[won]] = sender[won]
        # rows with an empty register wait longer, and draw again
        short = np.zeros(n, bool)
        short[rows[todo]] = True
        short &= np.isinf(soonest).reshape(n, m).any(axis=1)
        wait[short] *= 2
        todo = todo[short[rows[todo]]]
    return kept.reshape(n, m)


def signatures(texts: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """Of each text: a 128-bit key of its word sequence (null if it has no words), and its BANDS buckets."""
    keys: list[bytes | None] = [None] * len(texts)
    buckets = np.zeros((len(texts), BANDS), np.uint64)
    for first, offsets, data in text_blocks(texts, 0, limit=1 << 18, lower=True):
        n = len(offsets) - 1
        words, bounds = word_hashes(offsets, data)
        some = np.flatnonzero(np.diff(bounds))
        pair = np.stack([_range_hashes(words, bounds[:-1], bounds[1:], 1 + i) for i in (0, 1)], axis=1)
        for i in some.tolist():
            keys[first + i] = pair[i].tobytes()
        kept = registers(*shingle_bags(words, bounds), n).reshape(n, BANDS, ROWS)
        code = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP), (n, BANDS)).copy()
        for row in range(ROWS):
            code = mix(code ^ kept[:, :, row])
        buckets[first : first + n] = code
    return keys, buckets


Bag = tuple[np.ndarray, np.ndarray]


def similarity(a: Bag, b: Bag) -> float:
    """Probability Jaccard of two bags (ascending shingles, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    if not len(i):
        return 0.0
    weight_a, weight_b = int(a[1].sum()), int(b[1].sum())
    if weight_a == len(a[0]) and weight_b == len(b[0]):
        return len(i) / (weight_a + weight_b - len(i))
    # sum over common s of 1 / sum over t of max(a_t / a_s, b_t / b_s), by the order of the ratios a_t / b_t
    x, y = a[1][i].astype(float), b[1][at[i]].astype(float)
    only_a, only_b = weight_a - x.sum(), weight_b - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    place = np.searchsorted(ratio, ratio, side="left")
    more_a = x.sum() - np.r_[0, np.cumsum(x)][place] + only_a  # shingles whose ratio is at least that of s
    more_b = np.r_[0, np.cumsum(y)][place] + only_b
    return float((1 / (more_a / x + more_b / y)).sum())


def bags(texts: pa.Array) -> Iterator[Bag]:
    """Of each text: ascending distinct shingles, with counts."""
    for _, offsets, data in text_blocks(texts, 0, limit=1 << 18, lower=True):
        rows, shingles, counts = shingle_bags(*word_hashes(offsets, data))
        ends = np.searchsorted(rows, np.arange(len(offsets)))
        yield from ((shingles[low:high], counts[low:high]) for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def bag(text: str) -> Bag:
    return next(bags(pa.array([text], pa.large_string())))


def links_between(of: list[Bag], tree: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of similar bags that join all similar ones of different trees and sides; bags of side -1 are on both.

    Probability Jaccard is at most the common weight, the sum of the smaller shares. With the shingles of every bag in
    one order, the common weight of two bags lies at and behind their first common shingle, so this one is in the
    prefix of both: the shingles that have the threshold of the bag's weight at and behind them.
    """
    sizes = np.array([len(b[0]) for b in of])
    owner, shingles = np.repeat(np.arange(len(of)), sizes), np.concatenate([b[0] for b in of])
    share = np.concatenate([b[1] / b[1].sum() for b in of])
    _, which, often = np.unique(shingles, return_inverse=True, return_counts=True)
    order = np.lexsort((which, often[which], owner))
    which, share = which[order], share[order]
    before = np.cumsum(share) - share
    begins = np.cumsum(sizes) - sizes
    kept = np.flatnonzero(1 - (before - np.repeat(before[begins], sizes)) >= threshold - 1e-9)
    which, owner = which[kept], owner[kept]  # the prefixes, by owner
    starts = np.searchsorted(owner, np.arange(len(of) + 1))
    by_shingle = np.argsort(which, kind="stable")
    listed, lows = owner[by_shingle], np.searchsorted(which[by_shingle], np.arange(len(often) + 1))
    tree = tree.copy()
    names, members = np.unique(tree, return_counts=True)
    for x in np.flatnonzero(tree != names[members.argmax()]).tolist():  # one of two trees is not the largest
        own = which[starts[x] : starts[x + 1]]
        own = own[lows[own + 1] - lows[own] > 1]
        if not len(own):
            continue
        met = np.concatenate([listed[lows[s] : lows[s + 1]] for s in own.tolist()])
        met = np.unique(met[(tree[met] != tree[x]) & ((side[met] != side[x]) | (side[x] < 0))])
        for y in met.tolist():
            if tree[y] != tree[x] and similarity(of[x], of[y]) >= threshold:
                yield x, y
                tree[tree == tree[y]] = tree[x]


def _signed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.octet_length(text_column).cast("long").alias("size"), F.col(text_column).alias("text"))
    schema = rows.drop("text").schema.add("key", T.BinaryType()).add("buckets", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                keys, buckets = signatures(part.column(3))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(offsets, pa.array(buckets.astype(np.int64, casting="unsafe").ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.binary()), lists], names=["doc_id", "text_hash", "size", "key", "buckets"])

    return rows.mapInArrow(run, schema)


def _parts(n: int, each: int) -> int:
    """Partitions for so many rows or bytes: a small table in many partitions costs files and tasks."""
    return max(1, -(-n // each))


def contract(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the same nodes as those that come in, each node to the smallest of its component."""

    def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
        x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
        while True:  # every root takes the smallest root that it is linked with, and paths are halved
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in links:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CONTRACTED:
            yield star(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
            held = []
    if held:
        yield star(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of the edges (a, b)."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n = edges.count()
        parts = _parts(n, ROWS_A_TASK)
        edges = checkpointed(edges.coalesce(parts).mapInArrow(contract, edges.schema))
        # an edge always points from the larger to the smaller node; done when all point to roots
        if n > ROWS_A_TASK:
            inner = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
            several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
            done = inner.unionByName(several).isEmpty()
        if n <= ROWS_A_TASK or done:  # one partition is contracted to the end
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.distinct())


def _one_of_equals(members: DataFrame) -> DataFrame:
    """Of buckets with several nodes one for each set of nodes, with how many there are: bucket, copies."""
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return sets.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("copies")).select("bucket", (F.col("n") * F.col("copies")).alias("meets"))


def _in_order(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows with texts of `size` bytes, dealt by the first two keys and sorted by all."""
    parts = max(_parts(size, BYTES_A_TASK), 2 * rows.sparkSession.sparkContext.defaultParallelism if size > BYTES_A_TASK else 1)
    return rows.repartition(parts, *keys[:2]).sortWithinPartitions(*keys)


def _linked_to_leaders(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the nodes of each bucket and its leader."""
    lead = members.groupBy("bucket").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("leader"))
    pairs = checkpointed(members.join(lead, "bucket").where("node <> leader").select("leader", "node", "size").distinct())
    loads = pairs.groupBy("leader").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("parts"))
    total = pairs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    nodes = pairs.join(loads, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("place"))
    itself = loads.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    rows = nodes.unionByName(itself).join(texts, "node").select("leader", "part", "place", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None  # the row of a leader comes before those that are compared with it
        for batch in batches:
            a, b = [], []
            for which, place, node, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), bags(batch.column(4)), strict=True):
                if not place:
                    leader, own = which, (found[0].copy(), found[1].copy())
                elif which == leader and similarity(own, found) >= threshold:
                    a.append(which)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _in_order(rows, total, "leader", "part", "place").mapInArrow(run, "a bigint, b bigint")


def _linked_in_blocks(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all similar nodes of different roots of each bucket (bucket, node, root, size)."""
    # a class with more than a block of text gets blocks of its own; all others of a bucket share blocks
    loads = members.groupBy("bucket", "root").agg(F.sum("size").alias("bytes"))
    big = loads.where(F.col("bytes") > BLOCK_BYTES).select("bucket", "root", F.col("root").alias("own"))
    placed = members.join(big, ["bucket", "root"], "left")
    groups = placed.groupBy("bucket", "own").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    groups = groups.withColumn("blocks", F.greatest("blocks", F.lit(1)))
    along = Window.partitionBy("bucket").orderBy("own")  # one row for each block's worth of text, at most
    groups = groups.withColumns({"end": F.sum("blocks").over(along), "all": F.sum("blocks").over(Window.partitionBy("bucket"))})
    groups = groups.select(F.col("bucket").alias("of_bucket"), F.col("own").alias("of_own"), "blocks", "end", "all")
    dealt = placed.join(groups, (F.col("bucket") == F.col("of_bucket")) & F.col("own").eqNullSafe(F.col("of_own")))
    dealt = dealt.withColumn("block", (F.col("end") - F.col("blocks") + F.pmod(F.xxhash64("node"), "blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all").cast("int") - 1), lambda y: F.col("own").isNull() | (y < F.col("end") - F.col("blocks")) | (y >= F.col("end")))
    dealt = checkpointed(dealt.select("bucket", "node", "root", "size", "block", F.explode(others).alias("other")))
    total = dealt.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    rows = dealt.join(texts, "node").select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "text")

    def compare(group: pa.Table) -> pa.RecordBatch:
        i, j, block, node, root = (group.column(k).to_numpy() for k in range(1, 6))
        side = np.full(len(block), -1) if i[0] == j[0] else block
        found = []
        if len(np.unique(root)) > 1:
            found = list(links_between(list(bags(group.column(6).combine_chunks())), root, side, threshold))
        return pa.RecordBatch.from_arrays([pa.array([int(node[p[k]]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, 3, compare)

    return _in_order(rows, total, "bucket", "i", "j").mapInArrow(run, "a bigint, b bigint")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work() of each run of rows with equal numbers in the first `keys` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield work(pa.Table.from_batches(held))
            held = []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if low:
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield work(pa.Table.from_batches(held))


def _links(texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """node, root of every node that got a link; members: bucket, node, size, score; texts: node, text."""
    roots = checkpointed(components(_linked_to_leaders(members, texts, threshold)))
    rooted = members.select("bucket", "node", "size").join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("bucket")
    left = checkpointed(rooted.join(several, "bucket"))
    if left.isEmpty():
        return roots
    edges = _linked_in_blocks(left, texts, threshold)
    return components(edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _classified(docs: DataFrame, id_column: str, text_column: str, threshold: float) -> DataFrame:
    """doc_id, text_hash, class_id, class_hash (id and text of the representative) of every document."""
    small_batches(docs.sparkSession)
    signed = checkpointed(_signed(docs, id_column, text_column))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min(rank).alias("first"), F.max("size").alias("size"), F.first("buckets").alias("buckets"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    met = checkpointed(entries.join(_one_of_equals(entries), "bucket"))
    if met.isEmpty():
        classes = nodes.select("key", "first")
    else:
        scores = met.groupBy("node").agg(F.sum("meets").alias("score"))
        members = checkpointed(met.drop("meets").join(scores, "node"))
        firsts = nodes.join(scores.select("node"), "node", "left_semi").select("node", F.col("first.doc_id").alias("want_id"), F.col("first.text_hash").alias("want_hash"))
        source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
        found = source.join(firsts, source["doc_id"].eqNullSafe(firsts["want_id"]) & (source["text_hash"] == firsts["want_hash"]))
        texts = checkpointed(found.select("node", "text").dropDuplicates(["node"]))
        roots = _links(texts, members, threshold)
        rooted = nodes.select("key", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of_root = rooted.groupBy("root").agg(F.min("first").alias("class_first"))
        classes = rooted.join(of_root, "root").select("key", F.col("class_first").alias("first"))
    placed = signed.select("doc_id", "text_hash", "key").join(classes, "key", "left")
    alone = F.col("key").isNull()
    return placed.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.col("text_hash")).otherwise(F.col("first.text_hash")).alias("class_hash"),
        alone.alias("wordless"),
    )


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id."""
    return _classified(docs, id_column, text_column, threshold).select("doc_id", "class_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all columns of docs; wordless documents all stay."""
    found = _classified(docs, id_column, text_column, threshold)
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    key, text_hash, wordless, copy = (unused(docs, c) for c in ("kept_id", "kept_hash", "kept_wordless", "kept_copy"))
    kept = found.where(own).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash)).agg(F.max("wordless").alias(wordless))
    joined = docs.join(kept, docs[id_column].eqNullSafe(kept[key]) & (F.xxhash64(docs[text_column]) == kept[text_hash]))
    others = [F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema if f.name not in (id_column, text_column)]
    numbered = joined.withColumn(copy, F.row_number().over(Window.partitionBy(key, text_hash).orderBy(*others, F.lit(1))))
    return numbered.where(F.col(copy).eqNullSafe(1) | F.col(wordless)).select(*docs.columns)
