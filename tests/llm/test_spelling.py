"""Spelling variants against definitions in plain Python: counts, all pairs by edit distance, forms and roots."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import queries, spelling
from tests.llm.test_operators import docs_of


def naive_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def naive_near(words):
    """Pairs one edit apart, by patterns of words with one place left open or inserted."""
    by = {}
    for w in words:
        for i in range(len(w) + 1):
            by.setdefault((w[:i], w[i:], "insert"), set()).add(w)
            if i < len(w):
                by.setdefault((w[:i], w[i + 1 :], "replace"), set()).add(w)
                by.setdefault((w[:i], w[i + 1 :], "insert"), set()).add(w)
    near = {w: set() for w in words}
    for (_, _, kind), found in by.items():
        for w in found:
            near[w] |= {x for x in found if x != w and (kind == "replace" or abs(len(x) - len(w)) == 1)}
    return near


def naive_groups(rows):
    n = naive_words(rows)
    near, form = naive_near(n), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def got_groups(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = naive_groups(rows)
    assert len(want) > 1000 and any(form for form, *_ in want.values())
    assert got_groups(queries.op12_spelling_variants(spark, sf_dir)) == want


def dense(seed, n=700, letters="abé", sizes=(5, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    return {w: rng.choice([3, 4, 8, 20, 50]) for w in sorted(words)}


def test_reference_of_the_tests_is_edit_distance():
    words = dense(1, 120)
    near = naive_near(words)
    assert all((b in near[a]) == (distance(a, b) == 1) for a in words for b in words)
    assert all(spelling.one_edit(a, b) == (distance(a, b) == 1) for a in words for b in words)


@pytest.mark.parametrize(("cell", "few", "scanned"), [(1 << 14, 24, 128), (40, 0, 128), (5, 24, 128), (1 << 14, 0, 6)])
def test_links_in_cells_of_any_size(spark, monkeypatch, cell, few, scanned):
    """Words over three letters share their halves by hundreds; small cells deal them over grids."""
    words = dense(2)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "SCANNED", scanned)
    monkeypatch.setattr(spelling, "FEW", few)  # of the driver; scan_shard is tested with it below
    rows = spelling.links(frame, cell=cell, shard_rows=300).collect()
    want = {(a, b, words[b]) for a, found in naive_near(words).items() for b in found}
    assert len(rows) == len(want) > 1000 and {tuple(r) for r in rows} == want
    routed = [r.asDict() for r in spelling._routed(frame, cell, 300).collect()]
    assert cell > 40 or max(Counter(r["cell"] for r in routed if r["half"]).values()) < 6 * cell
    table = pa.Table.from_pylist(routed)
    local = [tuple(x.values()) for shard in {r["shard"] for r in routed} for x in spelling.scan_shard(table.filter(pa.compute.equal(table["shard"], shard))).to_pylist()]
    assert sorted(local) == sorted(want)


def test_roots_of_long_chains(spark):
    chain = [("word", f"w{i:02}", f"w{i + 1:02}" if i < 40 else None) for i in range(41)]
    frame = spark.createDataFrame([(w, f) for _, w, f in chain] + [("alone", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.with_roots(frame).collect()} == {f"w{i:02}": "w40" for i in range(41)} | {"alone": "alone"}


def test_variant_cases(spark):
    long = "ab" * 600
    rows = [(1, None), (2, ""), (3, "12 !? 日本"), (None, "Straße straße STRAßE"), (4, "straase straase straase"), (4, "straase straase straase"), (5, f"{long} {long}x"), (6, f"{long} {long}x"), (7, f"{long} {long}x {long}"), (8, "cut×off cut×off cut×off"), (9, "four four four four")]
    docs = docs_of(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert got_groups(spelling.groups(docs)) == naive_groups(rows)
    assert naive_groups(rows)["straase"][2] == 6 and naive_groups(rows)[long + "x"][3] == 1 and "cut×off" in naive_groups(rows)
    assert spelling.groups(docs.limit(0)).count() == 0
    assert spelling.groups(docs.where("doc_id = 2")).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_very_long_words(spark):
    long = "ab" * 100_000
    docs = docs_of(spark, [(i, f"{long} {long[:70000]}x{long[70000:]} {long[1:]}") for i in (5, 6, 7)])
    got = got_groups(spelling.groups(docs))
    assert sorted((len(w), n_near) for w, (_, _, _, n_near, _) in got.items()) == [(199_999, 1), (200_000, 2), (200_001, 1)]
