"""Packing documents into sequences of fixed length: shortest pack first over the length histogram.

Documents are encoded by a byte-level vocabulary and closed by an end token; a document longer than a sequence is
cut into full sequences and a rest, so every piece has 1 to `limit` tokens and their histogram has at most `limit`
lengths, whatever the size of the corpus. On this histogram (the one thing the driver sees) lengths are
placed longest first: as many pieces of a length as possible go, together, to the open pack that is
shortest so far, as long as it has room, else to new packs. What is kept are patterns, that is lists of lengths with the
number of packs that look so; placing pieces splits the count of one pattern at most, so the work depends on the number
of different lengths and not on that of documents.

Patterns go back to the pieces by rank: the pieces of a length are numbered without gaps, and every slot of a
pattern owns a range of these numbers. Numbers come from buckets of a length (a frequent length has
many), counted first and then numbered inside; so no task holds all pieces of a length. Tables of
lengths, buckets and slots are broadcast: at most `limit`, 2**16 + limit, and as many rows as there are placements.

Cases: a null or empty text is one piece that holds the end token alone; texts of any length are encoded whole;
repeated rows are packed one by one; an empty table gives no rows; other columns pass through, and of those named like a
result the new ones replace the old. The same rows in the same files get the same places.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import checkpointed, small_batches, unused

#: Tokens of a sequence, and the id that closes a document.
LIMIT, END_ID = 2048, 1
#: Pieces that are numbered in one go, and the most buckets there are besides one a length (larger ones beyond that).
BUCKET_ROWS, BUCKETS = 1024, 1 << 16
PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]

#: What the fast encoder is not used for: characters beyond Latin and common punctuation (whose classes differ
#: between versions of Unicode), long runs of white space (on which it fails), and strings of special tokens.
_PLAIN = re.compile("[\x00-ɏ‐-‧€]*")
_SLOW = re.compile(r"\s{256}|<\|")


class ByteBpe:
    """Encoder of a `tokenizers` file of the byte-level kind: the library itself, and for plain texts a faster one
    with the same pattern, ranks and results."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from canopy.llm.bpe import byte_letters

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec["pre_tokenizer"], spec["model"]
        self._fast = None
        # ids are ranks in this kind of file: single bytes first, then what each merge makes
        if cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"] and not model.get("ignore_merges"):
            unletter = {c: b for b, c in enumerate(byte_letters())}
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(unletter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            merges = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
            by_rank = [model["vocab"][t] for t in merges]
            if by_rank == sorted(by_rank) and len(merges) + 256 == len(ranks) and all(s.startswith("<|") for s in special):
                self._fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, "<u4")
        if self._fast is not None and _PLAIN.fullmatch(text) and not _SLOW.search(text):
            return np.array(self._fast.encode_ordinary(text), "<u4")
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")


#: Fixed value: the pattern by which byte-level vocabularies of this kind cut a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The worker's encoder of a vocabulary file."""
    return ByteBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, text_column: str = "text") -> DataFrame:
    """The columns of docs without the text, once for each piece, with start, length, ids (little-endian
    unsigned 32-bit numbers) and doc_tokens (with the end token)."""
    small_batches(docs.sparkSession)
    added = [name for name, _ in PIECE]
    kept = [c for c in docs.columns if c not in (*added, text_column)]
    schema = T.StructType([*docs.select(*kept).schema.fields, *[T.StructField(n, t, False) for n, t in PIECE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows, starts, lengths, ids, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(len(kept)).to_pylist()):
                tokens = np.append(own.encode(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(tokens), limit):
                    part = tokens[start : start + limit]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part))
                    ids.append(part.tobytes())
                    totals.append(len(tokens))
            at = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(at) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], names=[*kept, *added])

    return docs.select(*kept, text_column).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(number of packs, their lengths in order of placing) for pieces of a histogram: longest lengths first, each to
    the pack that is shortest so far."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by tokens so far
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            shortest = min(open_packs, default=limit)
            if shortest + length > limit:  # new packs, each filled with this length before the next is opened
                many = limit // length
                for count, size in ((left // many, many), (min(1, left % many), left % many)):
                    if count:
                        open_packs[size * length].append((count, [length] * size))
                break
            count, lengths = open_packs[shortest].pop()
            placed = min(count, left)
            if placed < count:
                open_packs[shortest].append((count - placed, lengths))
            elif not open_packs[shortest]:
                del open_packs[shortest]
            open_packs[shortest + length].append((placed, [*lengths, length]))
            left -= placed
    return [pattern for _, group in sorted(open_packs.items(), reverse=True) for pattern in group]


def slots(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, packs, sequence of the first, offset) of every length of every pattern: equal
    lengths stand side by side in a pattern, so ranks fill the first such slot of all packs, then the next."""
    out, used, sequence = [], defaultdict(int), 0
    for count, lengths in packs:
        offset = 0
        for length, equal in groupby(lengths):
            n = len(list(equal))
            out.append((length, used[length], used[length] + count * n, count, sequence, offset))
            used[length] += count * n
            offset += length * n
        sequence += count
    return out


def pack(cut: DataFrame, limit: int = LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of cut (pieces of 1 to `limit` tokens, by the column length), with sequence_id and offset."""
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    names = cut.columns
    key, bucket, buckets, rank, before, begin, end, packs, first = (unused(cut, n) for n in ("key", "bucket", "buckets", "rank", "before", "begin", "end", "packs", "first"))
    cut = checkpointed(cut.withColumn(key, F.monotonically_increasing_id()))  # encoded once, and keys settled
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    if any(not 0 < length <= limit for length in histogram):
        raise ValueError(f"pieces must have 1 to {limit} tokens")
    a_bucket = max(bucket_rows, sum(histogram.values()) // BUCKETS)
    lengths = spark.createDataFrame([(length, -(-n // a_bucket)) for length, n in histogram.items()], f"length long, {buckets} long")
    rows = cut.join(F.broadcast(lengths), "length").withColumn(bucket, F.pmod(F.xxhash64(key), F.col(buckets))).drop(buckets)
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    counts = rows.groupBy("length", bucket).agg(F.count("*").alias("n"))
    begins = counts.select("length", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", bucket).orderBy(key)
    ranked = rows.withColumn(rank, F.row_number().over(inside)).join(F.broadcast(begins), ["length", bucket])
    ranked = ranked.withColumn(rank, F.col(rank) - 1 + F.col(before))
    places = spark.createDataFrame(slots(patterns(histogram, limit)), f"length long, {begin} long, {end} long, {packs} long, {first} long, offset long")
    placed = ranked.join(F.broadcast(places), "length").where((F.col(rank) >= F.col(begin)) & (F.col(rank) < F.col(end)))
    at = F.col(rank) - F.col(begin)
    slot = F.expr(f"({rank} - {begin}) div {packs}")
    return placed.select(*names, (F.col(first) + at % F.col(packs)).alias("sequence_id"), (F.col("offset") + slot * F.col("length")).alias("offset"))


def sequences(packed: DataFrame, limit: int = LIMIT, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, n_padded and ids of each sequence: its pieces in order, then padding up to `limit` tokens,
    but for sequences whose size is a power of two, which stay as they are. A sequence has `limit` pieces at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    size = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(limit))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    return parts.select("sequence_id", "n_tokens", (size - F.col("n_tokens")).alias("n_padded"), F.rpad(ids, (size * 4).cast("int"), pad).alias("ids"))
