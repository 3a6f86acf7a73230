"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Nearness is the inner product. Vectors get one more component, sqrt(M^2 - |x|^2) for the largest norm M, so
that the largest inner product is the smallest distance, and a k-means tree is grown on a bounded sample
of them: nodes split into up to BRANCHES clusters until a leaf stands for about LEAF_ROWS rows. Every row
is then filed in a leaf. A query walks the tree with a priority queue, nearest centre first. How many
leaves it visits is calibrated: for a bounded set of queries the true neighbours are found among all
rows, and visits widen until TARGET of the neighbours of one half of them lie in visited leaves (and k rows at least). The
share that the other half reaches is returned with every row, as the run's measured recall.

Leaves are visited in phases: the FIRST_VISITS nearest ones, then PHASE times as many, and so on. After each
phase a query knows its k-th best score so far, and later leaves only hand on rows that reach it, so that
rows on the way grow with the queries and not with the leaves that they visit.

Leaves meet their queries in blocks of at most about POINT_BLOCK rows by QUERY_BLOCK queries, so that a
leaf with a third of the rows, or of the queries, is spread over many tasks. Rows that repeat id and vector are one
row; of the ids with equal vectors only the k + 1 smallest can be in an answer, and only these are filed.

Cases: null ids, and vectors that are null, zero, or hold null or non-finite components, take no part; nor
do vectors of another length than the most frequent one; a row is never its own neighbour, but rows that
repeat its id with another vector can be; repeated queries are answered once; fewer than k candidates give as many
neighbours; empty tables give no rows; ties go to the smaller id; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import checkpointed

BRANCHES = 8
LEAF_ROWS = 512
MAX_LEAVES = 4096
#: So many rows, chosen by a hash of the id, teach the tree; 64 for each leaf wanted, at least.
SAMPLE_ROWS = 1 << 16
#: Bytes of the sample; of wide vectors fewer rows are taken.
SAMPLE_BYTES = 1 << 26
CALIBRATION_QUERIES = 128
TARGET = 0.96
POINT_BLOCK, QUERY_BLOCK = 8192, 4096
FIRST_VISITS, PHASE = 4, 4
_OUT = "query_id bigint, query_hash bigint, vec_id bigint, score double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in a fixed order of summation, so that equal vectors get equal scores."""
    return (x * y).sum(axis=1)


class Tree:
    def __init__(self, sample: np.ndarray, largest: float, leaves: int, seed: int = 5):
        self.largest = largest
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        points = self.lift(sample)
        capacity = max(1, len(points) / max(1, leaves))
        rng = np.random.default_rng(seed)
        self._grow(points, points.mean(axis=0) if len(points) else np.zeros(points.shape[1]), capacity, rng, 0)
        self.stacked = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))]

    def _grow(self, points: np.ndarray, centre: np.ndarray, capacity: float, rng: np.random.Generator, depth: int) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        split = self._split(points, min(BRANCHES, int(np.ceil(len(points) / capacity))), rng) if len(points) > 1.5 * capacity and depth < 24 else None
        if split is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(points[split[1] == i], c, capacity, rng, depth + 1) for i, c in enumerate(split[0])]
        return node

    @staticmethod
    def _split(points: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        different = np.unique(points, axis=0) if len(points) < 64 else points
        if parts < 2 or len(different) < 2:
            return None
        centres = different[rng.choice(len(different), min(parts, len(different)), replace=False)]
        for _ in range(10):
            own = nearest(points, centres)
            used = np.unique(own)
            centres = np.stack([points[own == i].mean(axis=0) for i in used])
        own = nearest(points, centres)
        used, own = np.unique(own, return_inverse=True)
        return (centres[used], own) if len(used) > 1 else None

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        points, out = self.lift(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.stacked[node] is None:
                out[rows] = self.leaf[node]
                continue
            own = nearest(points[rows], self.stacked[node])
            todo += [(kid, rows[own == i]) for i, kid in enumerate(self.children[node]) if (own == i).any()]
        return out

    def visit(self, query: np.ndarray, visits: int, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves nearest first: `visits` of them, and on until they hold `rows` rows."""
        scale = self.largest / np.sqrt((query * query).sum())
        target = np.r_[query * scale, 0.0]
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < rows):
            _, node = heapq.heappop(queue)
            if self.stacked[node] is None:
                if sizes[self.leaf[node]]:
                    out.append(self.leaf[node])
                    held += int(sizes[self.leaf[node]])
                continue
            gaps = ((self.stacked[node] - target) ** 2).sum(axis=1)
            for kid, gap in zip(self.children[node], gaps.tolist(), strict=True):
                heapq.heappush(queue, (gap, kid))
        return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)


def best(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, rows of its k best points, their scores), ties to the smaller id; own: of each query the row that it
    is itself, or -1."""
    for low in range(0, len(queries), 256):
        rough = queries[low : low + 256] @ points.T
        for i, line in enumerate(rough):
            q = low + i
            if own[q] >= 0:
                line[own[q]] = -np.inf
            if len(line) > k:
                least = np.partition(line, len(line) - k)[len(line) - k]
                at = np.flatnonzero(line >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.flatnonzero(np.isfinite(line))
            else:
                at = np.flatnonzero(np.isfinite(line))
            scores = inner(points[at], queries[q][None, :])
            order = np.lexsort((ids[at], -scores))[:k]
            yield q, at[order], scores[order]


def own_rows(ids: np.ndarray, hashes: np.ndarray, query_ids: np.ndarray, query_hashes: np.ndarray) -> np.ndarray:
    """Of each query the row with its id and vector, or -1."""
    at = {x: i for i, x in enumerate(zip(ids.tolist(), hashes.tolist(), strict=True))}
    return np.array([at.get(x, -1) for x in zip(query_ids.tolist(), query_hashes.tolist(), strict=True)], np.int64)


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v, h (hash of v) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(good).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).withColumn("h", F.xxhash64("v"))


def search(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", target: float = TARGET, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, nearest first; and recall: the
    share of the true neighbours of the calibrating queries that are found, the same in all rows."""
    spark = vectors.sparkSession
    answer = "query_id bigint, rank int, vec_id bigint, score double, recall double"
    points = clean(vectors, id_column, vector_column)
    equal = Window.partitionBy("h", "v").orderBy("vec_id")
    points = points.dropDuplicates(["vec_id", "h", "v"]).withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy")
    asked = clean(queries, id_column, vector_column).dropDuplicates(["vec_id", "h", "v"])
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    points = checkpointed(points)
    facts = points.agg(F.count("*").alias("n"), F.max(squares).alias("s"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return spark.createDataFrame([], answer)
    n, largest = facts["n"], float(np.sqrt(facts["s"]))
    scale, rows = 1 << 30, max(1024, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * facts["width"])))
    share = min(scale, rows * scale // n + 1)
    drawn = points.where(F.pmod(F.xxhash64(F.lit("tree"), "vec_id", "h"), F.lit(scale)) < share).select("v").limit(2 * rows).toArrow()
    leaves = int(min(MAX_LEAVES, max(1, n // leaf_rows), max(1, rows // 16)))
    if not drawn.num_rows:  # a handful of rows can all miss the draw
        drawn = points.select("v").limit(rows).toArrow()
    tree = Tree(matrix(drawn.column(0)), largest, leaves)
    shared = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES centres and their ancestors

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.file(matrix(batch.column(1))))], names=[*batch.schema.names, "leaf"])

    filed = checkpointed(points.mapInArrow(file, T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())])))
    sizes = np.zeros(tree.leaves, np.int64)
    for row in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf
        sizes[row["leaf"]] = row["n"]
    visits, recall = calibrate(filed, asked, tree, sizes, k, target)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [shared.value.visit(q, visits, sizes, k + 1) for q in matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    walked = asked.mapInArrow(walk, T.StructType([*asked.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))]))
    walked = walked.select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_hash"), F.col("v").alias("q"), F.posexplode("leaves").alias("place", "leaf"))
    walked = checkpointed(walked)
    longest = walked.agg(F.max("place").alias("p")).first()["p"]
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    found = spark.createDataFrame([], _OUT)
    low, high = 0, FIRST_VISITS
    while longest is not None and low <= longest:
        floors = found.groupBy("query_id", "query_hash").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
        visits_now = walked.where((F.col("place") >= low) & (F.col("place") < high)).join(floors, ["query_id", "query_hash"], "left")
        met = _scan_leaves(visits_now, filed, sizes, k).unionByName(found)
        found = checkpointed(met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        low, high = high, high * PHASE
    return found.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score", F.lit(recall).alias("recall"))


def _scan_leaves(visits: DataFrame, filed: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each visited leaf block for each query, as far as they reach the query's floor."""
    asked = visits.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("query_blocks"))
    blocks = visits.sparkSession.createDataFrame([(i, int(-(-s // POINT_BLOCK))) for i, s in enumerate(sizes.tolist()) if s], "leaf int, point_blocks int").join(asked, "leaf")
    blocks = F.broadcast(blocks)  # one row per leaf
    query_block, point_block = F.pmod(F.xxhash64("query_id"), F.col("query_blocks")), F.pmod(F.xxhash64("vec_id"), F.col("point_blocks")).cast("int")
    query_side = visits.join(blocks, "leaf").select("query_id", "query_hash", "q", "floor", "leaf", query_block.alias("qb"), F.explode(F.sequence(F.lit(0), F.col("point_blocks") - 1)).alias("pb"))
    point_side = filed.join(blocks, "leaf").select("vec_id", "v", "h", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("qb"), point_block.alias("pb"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, own, hashes = (t.to_numpy() for t in (right["vec_id"], left["query_id"], left["query_hash"]))
            floor = left["floor"].fill_null(-np.inf).to_numpy()
            places = own_rows(ids, right["h"].to_numpy(), own, hashes)
            for q, at, scores in best(matrix(left["q"]), matrix(right["v"]), ids, places, k):
                good = scores >= floor[q]
                at, scores = at[good], scores[good]
                for column, part in zip(out, (np.full(len(at), own[q]), np.full(len(at), hashes[q]), ids[at], scores), strict=True):
                    column.append(part)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "query_hash", "vec_id", "score"])

    key = ["leaf", "qb", "pb"]
    return query_side.groupBy(*key).cogroup(point_side.groupBy(*key)).applyInArrow(scan, _OUT)


def calibrate(filed: DataFrame, asked: DataFrame, tree: Tree, sizes: np.ndarray, k: int, target: float) -> tuple[int, float]:
    """How many leaves to visit so that `target` of the true neighbours of every other sample query are in them, and which
    share of those of the rest is."""
    probes = asked.orderBy(F.xxhash64(F.lit("probe"), "vec_id", "h"), "vec_id").limit(CALIBRATION_QUERIES).select("vec_id", "v", "h").toArrow()
    if not probes.num_rows:
        return 1, 1.0
    probe_ids, probe_hashes, probe_vectors = probes["vec_id"].to_numpy(), probes["h"].to_numpy(), matrix(probes["v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:  # a running list of the k best per probe
            ids, leaf = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            places = own_rows(ids, batch.column(2).to_numpy(), probe_ids, probe_hashes)
            for q, at, scores in best(probe_vectors, matrix(batch.column(1)), ids, places, k):
                new = (scores, ids[at], leaf[at])
                both = tuple(np.concatenate(p) for p in zip(held[q], new, strict=True)) if q in held else new
                order = np.lexsort((both[1], -both[0]))[:k]
                held[q] = tuple(p[order] for p in both)
        if held:
            lists = [[np.full(len(s), q), s, i, leaf] for q, (s, i, leaf) in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*lists, strict=True)], names=["probe", "score", "vec_id", "leaf"])

    true = filed.select("vec_id", "v", "h", "leaf").mapInArrow(scan, "probe bigint, score double, vec_id bigint, leaf int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    true_rows = true.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "leaf").collect()  # at most CALIBRATION_QUERIES x k rows
    order = [{leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves, sizes, 0))} for v in probe_vectors]
    places = np.array([(r["probe"] % 2, order[r["probe"]][r["leaf"]]) for r in true_rows]).reshape(-1, 2)
    taught, held_out = (places[places[:, 0] == part, 1] for part in (0, 1))
    visits = 1
    while visits < tree.leaves and len(taught) and (taught < visits).mean() < target:
        visits += 1
    return visits, float((held_out < visits).mean()) if len(held_out) else 1.0
