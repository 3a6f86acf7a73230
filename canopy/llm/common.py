"""Helpers that the corpus operators share: lineage cuts, Arrow text buffers, hash tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.plans.lineage import checkpointed, ensure_checkpoint_dir  # noqa: F401

#: A slot of a HashTable that holds no key.
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in small batches, unless the session says otherwise: whole texts are long rows, and a worker
    and its executor hold a few batches each."""
    for name, usual, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", f"{64 << 20}b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def id_hash_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def labelled_passages(rows: DataFrame, docs: int, chars: int, total: int, most_labels: int) -> dict[object, list[str]]:
    """A bounded sample of rows (id, label, text) to learn from: for each label the passages of `docs` rows, or of as many
    fewer as keep all of them below `total` characters, chosen by a hash of id and text whatever the order of the rows. A
    passage is the text, or `chars` of it (of very many labels fewer) from a place that the hash chooses. More labels than
    most_labels are an error.
    """
    rows = rows.where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} different labels")
    if not counts:
        return {}
    chars = max(1, min(chars, total // len(counts)))
    each = max(1, min(docs, total // (chars * len(counts))))
    scale, draw = 1 << 30, F.xxhash64("id", "text", F.lit("sample"))
    shares = rows.sparkSession.createDataFrame([(label, min(scale, 2 * each * scale // n + 1)) for label, n in counts.items()], rows.select("label", F.lit(0).alias("share")).schema)
    drawn = rows.join(F.broadcast(shares), "label").where(F.pmod(draw, F.lit(scale)) < F.col("share"))  # at most most_labels rows
    start = F.pmod(F.xxhash64("id", "text", F.lit("place")), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    drawn = drawn.select("label", draw.alias("draw"), F.xxhash64("text").alias("key"), F.substr("text", start.cast("int"), F.lit(chars)).alias("text"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("draw", "key"))).where(F.col("rank") <= each)
    out: dict[object, list[str]] = {}
    for row in sorted(ranked.select("label", "rank", "text").collect(), key=lambda r: r["rank"]):  # at most `total` characters
        out.setdefault(row["label"], []).append(row["text"])
    return out


def text_runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about `limit` bytes of a text column; a longer row makes a run by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first, n = 0, len(sizes)
    while first < n:
        base = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last - first
        first = last


def text_blocks(texts: pa.Array, pad: int, limit: int = 1 << 18, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about `limit` bytes.

    Yields (first row, offsets, bytes): row r of the run starts at offsets[r] with `pad` zero bytes
    that stand for the start of the text. Nulls are empty texts. A longer row makes a run by itself.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for first, n in text_runs(texts, limit):
        part = texts.slice(first, n)
        if lower:
            part = pc.utf8_lower(part)
        if pad:
            part = pc.binary_join_element_wise(pa.scalar("\0" * pad, pa.large_string()), part, pa.scalar("", pa.large_string()))
        offsets, data = arrow_bytes(part)
        yield first, offsets, data


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a large_string array without nulls."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[low:high] if buffers[2] is not None and high > low else np.zeros(0, np.uint8)
    return offsets - low, data


class HashTable:
    """An open-addressing table from distinct uint64 keys to their positions, probed a vector at a time."""

    def __init__(self, keys: np.ndarray, load: float = 0.35):
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) / load))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots] == _EMPTY
            self.keys[slots[free]] = keys[left[free]]  # the last writer of a slot keeps it
            won = free & (self.keys[slots] == keys[left])
            self.rows[slots[won]] = left[won]
            left, slots = left[~won], (slots[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> self.shift).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for those that are absent."""
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.rows[slots], -1)
        left = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(left):
            slots_left = (slots[left] + 1) & self.mask
            slots[left] = slots_left
            seen = self.keys[slots_left]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[slots_left[hit]]
            left = left[~hit & (seen != _EMPTY)]
        return out


def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte: the byte itself in the low 8 bits, above it the `order` bytes before, latest lowest."""
    keys = data.astype(np.uint64)
    out = keys.copy()
    for back in range(1, order + 1):
        out[back:] |= keys[:-back] << np.uint64(8 * back)
    return out


def count_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with how often each occurs."""
    return np.unique(keys, return_counts=True)


def per_context(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context of each pair as a position, contexts, their totals, their distinct symbols) of sorted pairs."""
    contexts = pairs >> np.uint64(8)
    starts = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(pairs)])
    totals = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(starts)), sizes), contexts[starts], totals, sizes


def low_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys & np.uint64((1 << bits) - 1)
