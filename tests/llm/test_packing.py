"""Packing: the encoder against the tokenizer's own library, patterns against a pack at a time, laws of the result."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import packing, queries
from tests.llm.test_operators import docs_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def lawful(rows, limit=2048):
    """Offsets and starts without gaps, sizes within the limit; returns padding and tokens."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(0 if n & (n - 1) == 0 else limit - n for n in sizes), sum(sizes)


def test_packing_of_the_table(spark, library, sf_dir):
    rows = queries.op13_packing(spark, sf_dir).collect()
    padded, tokens = lawful(rows)
    assert padded <= 0.02 * tokens  # 200 documents; 0.08 % on 0.1
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        want[r["doc_id"]] = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    seen = {}
    for r in rows:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(ids) for i, ids in want.items()}


def test_encoder_equals_the_library(library):
    rng = random.Random(5)
    own = packing.encoder(packing.default_vocabulary())
    assert own._fast is not None
    kinds = [[chr(c) for c in range(0x250)] + ["’", "“", "€"], list(" \n\t'"), list("abcst"), list("日本語한글नमस्ते🙂̀ ퟻ")]
    texts = ["".join(rng.choice(rng.choice(kinds if i % 3 == 0 else kinds[:3])) for _ in range(rng.randint(0, 40))) for i in range(6000)]
    texts += [None, "", " " * 5000, "x" * 20000, "a<|endoftext|>b", "<|endoftext|>", "<|endof", "\n" * 300 + "a", "'s 've'll", "l'été 123 4567"]
    for text in texts:
        assert own.encode(text).tolist() == (library.encode(text, add_special_tokens=False).ids if text else [])


@pytest.mark.parametrize("seed", range(5))
def test_patterns_are_those_of_packs_one_at_a_time(seed):
    """Pieces one by one, each to the shortest pack with room: as many packs of each size."""
    rng = random.Random(seed)
    limit = rng.choice([16, 50, 100])
    pieces = sorted((rng.randint(1, limit) for _ in range(rng.randint(1, 400))), reverse=True)
    packs: list[int] = []
    for length in pieces:
        at = min(range(len(packs)), key=packs.__getitem__, default=None)
        if at is None or packs[at] + length > limit:
            packs.append(length)
        else:
            packs[at] += length
    got = packing.patterns({n: pieces.count(n) for n in set(pieces)}, limit)
    assert sorted(x for count, lengths in got for x in [sum(lengths)] * count) == sorted(packs)
    assert sorted(x for count, lengths in got for x in lengths * count) == sorted(pieces)
    taken = sorted((length, begin, end) for length, begin, end, *_ in packing.slots(got))
    for n in set(pieces):
        ranges = [(begin, end) for length, begin, end in taken if length == n]
        assert ranges[0][0] == 0 and ranges[-1][1] == pieces.count(n) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_patterns_take_steps_by_lengths_and_not_by_documents():
    packs = packing.patterns({n: 10**12 + 7 * n for n in range(1, 2049)})
    assert len(packs) < 20_000 and sum(c * sum(p) for c, p in packs) == sum(n * (10**12 + 7 * n) for n in range(1, 2049))


def test_packing_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "no id"), (4, "word " * 9000), (4, "word " * 9000), (5, "x" * 100_000)]
    docs = docs_of(spark, rows).withColumn("length", F.lit("clash")).withColumn("bucket", F.lit(7)).withColumn("Key", F.lit(8))
    cut = packing.pieces(docs, packing.default_vocabulary())
    packed = packing.pack(cut, bucket_rows=2)
    got = packed.collect()
    padded, tokens = lawful(got)
    assert packed.columns == ["doc_id", "lang", "source", "n_chars", "bucket", "Key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)) == [1, 1] and {r["bucket"] for r in got} == {7}
    assert sum(r["doc_id"] == 4 and r["start"] == 0 for r in got) == 2
    whole = packing.sequences(packed, pad_id=9).collect()
    assert sum(r["n_tokens"] for r in whole) == tokens and sum(r["n_padded"] for r in whole) == padded
    for r in whole:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["n_tokens"] + r["n_padded"] and (ids[r["n_tokens"] :] == 9).all()
        for p in got:
            if p["sequence_id"] == r["sequence_id"]:
                assert bytes(r["ids"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])] == bytes(p["ids"])
    assert packing.pack(cut.limit(0)).count() == 0
    with pytest.raises(ValueError, match="tokens"):
        packing.pack(spark.createDataFrame([(9,)], "length long"), limit=8)


def test_equal_documents_share_many_buckets(spark):
    cut = spark.range(3000).select(F.lit(5).cast("long").alias("length"))
    rows = packing.pack(cut, bucket_rows=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert lawful(rows)[1] == 15000


def test_many_short_documents_make_few_slots():
    packs = packing.patterns({1: 10**9, 700: 5})
    assert len(packing.slots(packs)) < 12 and sum(c * sum(p) for c, p in packs) == 10**9 + 3500
