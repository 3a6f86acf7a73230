"""Ranked lexical search over a tiered index: high-impact postings first, exact results with a proof.

A document scores, for every term it shares with an item, the term's weight (by its document frequency) times an impact
(by the term's frequency in the document and the document's length), all in integers. Per term, postings are
dealt to tiers by impact: tier 0 has about TIER postings of the highest impact, each further tier TIER_GROWTH times as many,
and postings of equal impact class stay together. For every tier the index knows the residual of each term: the highest
impact that is left below it.

A search starts with all items in tier 0. There, what a document's postings give is its partial score, and the
residuals of the item's other terms bound what lower tiers can add. The PROBES best partial scores are scored exactly;
the k-th of these is a threshold, and every document whose bound reaches it is scored exactly too. If documents that
have not been met in any tier so far (their bound is the sum of all residuals) cannot reach the k-th exact score, the item is
proven; items without this proof fall through to the next tier, alone. The last tier leaves no residual, so every
result is exact, whatever the tiers hold.

The index is held for the terms of the items, in blocks of items of ITEM_BYTES of text, so that the vocabulary, its
weights and bounds have a proven size and can be broadcast; it is written by document, so that partial scores are
aggregated where they are read. Work in a tier grows with its postings, not with the corpus.

Cases: null, empty and termless texts score nothing, and termless items get no rows; every row is a document of its own, also
those with equal or null ids (equal scores: ascending doc_id, nulls first); items with equal or null ids are searched
one by one; texts of any length are indexed whole; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import HashTable, checkpointed, ensure_checkpoint_dir, small_batches, text_blocks
from canopy.llm.near_dedup import _BYTE_HASH, _range_hashes

#: Results of an item, and documents whose exact scores give the first threshold.
K, PROBES = 20, 100
#: Postings of a term in tier 0, and how many times as many each further tier has.
TIER, TIER_GROWTH = 4096, 8
#: Classes of impacts have a width of 2 ** CLASS_BITS (impacts are below a million).
CLASS_BITS = 10
#: Text bytes of the items that are searched together.
ITEM_BYTES = 16 << 20
#: Pairs of item and document that are broadcast to be scored; more are joined by shuffles.
BROADCAST_PAIRS = 1 << 19
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def item_terms(items: DataFrame) -> DataFrame:
    """item, term, n of items (item, text)."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0))
    return items.select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count("*").alias("n"))


def weight(n_docs: int, document_frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * document_frequency + 1)))


class Vocabulary:
    """Terms by number, looked up by hash and compared byte for byte."""

    def __init__(self, terms: list[str]):
        raws = [t.encode() for t in terms]
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raws) + b"\0", np.uint8)
        for self.which in range(3):  # another hash should two terms have the same
            keys = _range_hashes(_BYTE_HASH[self.bytes], self.begins, self.begins + self.sizes, self.which)
            if len(np.unique(keys)) == len(keys):
                break
        self.table = HashTable(keys)
        self.size = len(terms)

    def count(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms of each row, row, number of a term, its occurrences) of blocks of texts."""
        for _, offsets, data in text_blocks(texts, 0):
            data = _LOWERED[data]
            inside = _IN_TERM[data]
            fresh = np.zeros(len(data) + 1, bool)
            fresh[offsets[:-1]] = True
            begins = np.flatnonzero(inside & (fresh[:-1] | ~np.r_[False, inside[:-1]]))
            stops = np.flatnonzero(inside & (fresh[1:] | ~np.r_[inside[1:], False])) + 1
            bounds = np.searchsorted(begins, offsets)
            at = self.table.lookup(_range_hashes(_BYTE_HASH[data], begins, stops, self.which))
            hit = np.flatnonzero(at >= 0)
            hit = hit[(stops - begins)[hit] == self.sizes[at[hit]]]
            term, sizes = at[hit].astype(np.int64), (stops - begins)[hit]
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            differs = data[np.repeat(begins[hit], sizes) + place] != self.bytes[np.repeat(self.begins[term], sizes) + place]
            same = np.ones(len(hit), bool)
            same[np.repeat(np.arange(len(hit)), sizes)[differs]] = False
            rows = np.searchsorted(bounds, hit[same], side="right") - 1
            pairs, counts = np.unique(rows * self.size + term[same], return_counts=True)
            yield np.diff(bounds), pairs // self.size, pairs % self.size, counts


def _lists(rows: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Values of sorted rows as one list a row."""
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """key, doc_id, n, terms, counts: of every document with any term at all, its number of terms and how often it has
    those of the list (by their place in it)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(terms))  # of at most ITEM_BYTES of text
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
    schema = rows.drop("text").schema.add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for sizes, row, term, count in shared.value.count(batch.column(2)):
                part = batch.slice(first, len(sizes))
                first += len(sizes)
                lists = _lists(row, len(sizes), pa.array(term.astype(np.int32)), pa.array(count.astype(np.int64)))
                made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), *lists], names=schema.names)
                yield made.filter(pa.array(sizes > 0))

    return rows.mapInArrow(run, schema)


@dataclass
class Index:
    """Postings by tier, and what is known of every term of the vocabulary."""

    folder: str
    terms: dict[str, int]
    weights: np.ndarray
    residuals: np.ndarray  # by term and tier

    def postings(self, spark: SparkSession, tier: int | None = None) -> DataFrame:
        """tier, key, doc_id, terms, impacts: a row for each document and tier that it has postings in."""
        rows = spark.read.parquet(self.folder)
        return rows if tier is None else rows.where(F.col("tier") == tier)

    @property
    def tiers(self) -> int:
        return self.residuals.shape[1]

    def remove(self, spark: SparkSession) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def build_index(docs: DataFrame, terms: list[str], tier: int = TIER, growth: int = TIER_GROWTH) -> Index | None:
    """The tiered index of docs (doc_id, text) for some terms; None if there is nothing to index."""
    spark = docs.sparkSession
    counted = checkpointed(term_counts(docs, terms))
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    if not n_docs or not terms:
        return None

    def impacts(n, count):
        return (10**9 * count) // (1000 * count + 12 * (75 + (25 * n * n_docs) // n_terms))

    posting = counted.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("n", F.col("p.terms").alias("term"), F.col("p.counts").alias("count"))
    impact = F.expr(f"(1000000000L * count) div (1000L * count + 12L * (75L + (25L * n * {n_docs}L) div {n_terms}L))")
    classes = posting.select("term", impact.alias("impact")).groupBy("term", F.shiftright("impact", CLASS_BITS).alias("class")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    higher = Window.partitionBy("term").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** (20 - CLASS_BITS) rows a term
    ends = [tier]
    while ends[-1] < n_docs:
        ends.append(ends[-1] * growth)
    before = F.coalesce(F.sum("n").over(higher), F.lit(0))
    placed = classes.withColumn("tier", sum((F.when(before >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)))
    known = placed.groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("class").alias("least"))
    frequency, most, least = np.zeros(len(terms), np.int64), np.zeros((len(terms), len(ends)), np.int64), np.full((len(terms), len(ends)), 1 << 40, np.int64)
    for r in known.toLocalIterator():  # a few numbers for each term of the block
        frequency[r["term"]] += r["n"]
        most[r["term"], r["tier"]], least[r["term"], r["tier"]] = r["most"], r["least"]
    if not frequency.any():
        return None
    # a posting is in the first tier whose least class is not above its own; what is left below a tier is the most of the later ones
    cuts = np.minimum.accumulate(least, axis=1)[:, :-1]
    residuals = np.maximum.accumulate(np.c_[most[:, 1:], np.zeros(len(terms), np.int64)][:, ::-1], axis=1)[:, ::-1]
    shared = spark.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term, count = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            impact = impacts(batch.column(2).to_numpy()[rows], count)
            tiers = (shared.value[term] > (impact >> CLASS_BITS)[:, None]).sum(axis=1)
            for t in np.unique(tiers).tolist():
                own = np.flatnonzero(tiers == t)
                kept, at = np.unique(rows[own], return_inverse=True)
                part = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), t, np.int32)), part.column(0), part.column(1), *_lists(at, len(kept), pa.array(term[own]), pa.array(impact[own]))], names=["tier", "doc_id", "key", "terms", "impacts"])

    schema = counted.select(F.lit(0).alias("tier"), "doc_id", "key", "terms", F.col("counts").alias("impacts")).schema
    folder = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    counted.select("doc_id", "key", "n", "terms", "counts").mapInArrow(run, schema).write.partitionBy("tier").parquet(folder)
    return Index(folder, {t: i for i, t in enumerate(terms)}, np.array([weight(n_docs, int(f)) for f in frequency], np.int64), residuals)


def _scores(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of documents (key, doc_id, terms, impacts and others), a row a posting, with the items' terms that it is for."""
    rows = postings.withColumn("p", F.explode(F.arrays_zip("terms", "impacts"))).drop("terms", "impacts")
    on = ["item", "term"] if "item" in rows.columns else ["term"]
    return rows.withColumn("term", F.col("p.terms")).join(F.broadcast(wanted), on)


def _exact(index: Index, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """item, key, doc_id, score of pairs of item and document."""
    pairs = checkpointed(pairs.select("item", "key").distinct())
    few = pairs.count() <= BROADCAST_PAIRS
    rows = index.postings(pairs.sparkSession).join(F.broadcast(pairs) if few else pairs, "key")
    return _scores(rows, wanted).groupBy("item", "key", "doc_id").agg(F.sum(F.col("weight") * F.col("p.impacts")).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k first of each item, with rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_index(index: Index, queries: dict[int, dict[int, int]], spark: SparkSession, k: int = K, probes: int = PROBES) -> tuple[DataFrame, list[int]]:
    """(item, rank, doc_id, score of the k best documents of each item; how many items were proven in each tier).
    queries: of each item how often it has which term of the index."""
    weighted = {item: [(t, n * int(index.weights[t])) for t, n in terms.items() if index.weights[t] > 0] for item, terms in queries.items()}
    live, found, proven = sorted(weighted), None, []
    for tier in range(index.tiers):
        rest = index.residuals[:, tier]
        bound = {item: sum(w * int(rest[t]) for t, w in weighted[item]) for item in live}
        wanted = spark.createDataFrame([(item, t, w, w * int(rest[t])) for item in live for t, w in weighted[item]], "item long, term int, weight long, residual long")
        met = _scores(index.postings(spark, tier).drop("tier"), wanted).groupBy("item", "key", "doc_id")
        met = checkpointed(met.agg(F.sum(F.col("weight") * F.col("p.impacts")).alias("score"), F.sum(F.col("weight") * F.col("p.impacts") - F.col("residual")).alias("gain")))
        exact = _exact(index, _best(met, max(k, probes)), wanted)
        exact = checkpointed(exact if found is None else exact.unionByName(found.select(exact.columns)).distinct())
        threshold = exact.groupBy("item").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("threshold"))  # at most k + probes rows an item
        bounds = spark.createDataFrame(list(bound.items()), "item long, bound long")
        hopeful = met.join(F.broadcast(threshold), "item").join(F.broadcast(bounds), "item").where("bound + gain >= coalesce(threshold, 0)")
        more = _exact(index, hopeful.join(exact.select("item", "key"), ["item", "key"], "left_anti"), wanted)
        found = checkpointed(_best(exact.unionByName(more).where("score > 0"), k))
        worst = {r["item"]: r["score"] for r in found.where(F.col("rank") == k).collect()}  # a number for each item of the block
        done = {item for item in live if bound[item] == 0 or bound[item] < worst.get(item, 0)}
        proven.append(len(done))
        live = [item for item in live if item not in done]
        if not live:
            break
    return found.select("item", "rank", "doc_id", "score"), proven


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES, tier: int = TIER) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    items = checkpointed(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("item")))
    blocks = 1 + items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // item_bytes
    out = items.limit(0).select("item", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for block in range(blocks):
        words = item_terms(items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)).collect()  # the terms of item_bytes of text
        terms = sorted({r["term"] for r in words})
        index = build_index(docs, terms, tier)
        if index is None:
            continue
        queries: dict[int, dict[int, int]] = {}
        for r in words:
            queries.setdefault(r["item"], {})[index.terms[r["term"]]] = r["n"]
        found, _ = search_index(index, queries, spark, k)
        out = out.unionByName(found)
        index.remove(spark)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
