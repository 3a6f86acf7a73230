"""Ranked search against plain Python, with tiers of every size, and the course of the proof."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import lexical_search
from tests.llm.test_operators import docs_of


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def naive(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score)."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // max(1, n_terms)
            score = 0
            for t in terms_of(text):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(n // 3)]  # a third of all are copies
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(20, docs[7][1]), (21, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("tier", [1, 4, 30, 4096])
def test_results_are_exact_with_tiers_of_any_size(spark, tier):
    docs, items = corpus(tier)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(lexical_search.search(docs_of(spark, docs), frame, k=10, tier=tier)) == naive(docs, items, 10)


def test_items_without_proof_fall_through(spark):
    docs, items = corpus(5, 900)
    words = sorted({t for _, text in items for t in terms_of(text)})
    index = lexical_search.build_index(docs_of(spark, docs), words, tier=40, growth=3)
    queries = {i: Counter(index.terms[t] for t in terms_of(text)) for i, text in items}
    found, proven = lexical_search.search_index(index, queries, spark, 5)
    assert sum(proven) == len(items) and len([n for n in proven if n]) > 1
    want = [x for x in naive(docs, items, 5)]
    assert sorted(map(tuple, found.collect()), key=str) == want
    # tiers go by impact, residuals are the most that is left below
    rows = index.postings(spark).select("tier", F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("tier", "p.*").toPandas()
    for term, own in rows.groupby("terms"):
        for t in range(index.tiers):
            later = own[own.tier > t].impacts
            assert index.residuals[term, t] == (later.max() if len(later) else 0)
            assert own[own.tier <= t].impacts.min() > index.residuals[term, t] or not len(own[own.tier <= t]) or not len(later)
    index.remove(spark)


def test_terms_of_odd_texts():
    rng = random.Random(3)
    alphabet = list("abAB09 ,.-_[]@`{}~\t\n") + ["é", "É", "ß", "日", " ", "🙂"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 300_000]
    words = sorted({t for text in texts[:200] for t in terms_of(text)} | {"x" * 300_000})
    vocabulary, rows = lexical_search.Vocabulary(words), []
    for sizes, row, term, count in vocabulary.count(pa.array(texts, pa.string())):
        base = len(rows)
        rows += [(int(n), {}) for n in sizes]
        for r, t, c in zip(row.tolist(), term.tolist(), count.tolist(), strict=True):
            rows[base + r][1][words[t]] = c
    known = set(words)
    assert rows == [(len(terms_of(t)), {w: n for w, n in Counter(terms_of(t)).items() if w in known}) for t in texts]
    assert np.array_equal(vocabulary.sizes, [len(w.encode()) for w in words])


def test_search_cases(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "same words here"), (4, "same words here"), (None, "same words here"), (5, "same words here"), (6, "other " * 50_000 + "words"), (7, "Ünï CASE")]
    items = [(1, "same WORDS same"), (1, "case"), (None, "other"), (2, None), (3, ""), (4, "nothing known"), (5, "?!")]
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("clash")).withColumn("n", F.lit(1))
    odd = docs_of(spark, docs).withColumn("key", F.lit("clash")).withColumn("terms", F.lit(1)).withColumn("score", F.lit(2))
    assert got(lexical_search.search(odd, frame)) == naive(docs, items)
    assert got(lexical_search.search(odd, frame, k=2, item_bytes=8)) == naive(docs, items, 2)  # many blocks
    for d, i in ((odd.limit(0), frame), (odd, frame.limit(0)), (odd.where("doc_id < 4"), frame), (odd, frame.where("item_id = 2"))):
        assert lexical_search.search(d, i).count() == 0
