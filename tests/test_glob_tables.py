"""Tables of globs against one regular expression for each."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from canopy.functions.globs import glob_match
from canopy.operators import glob_tables


def some_globs(rng, n):
    token = lambda: rng.choice(["a", "b", "0", "*", "?", "[ab]", "[^a]", "[0-9]", "\\*", "é", ".", "+"])
    return ["".join(token() for _ in range(rng.randint(0, 5))) for _ in range(n)] + ["[", "[]", "a\\", "[z-a]", "[]]", "**a**", "[a-]"]


def test_tries_match_what_each_glob_matches():
    rng = random.Random(1)
    globs = some_globs(rng, 400)
    trie = glob_tables.Trie(globs)
    for _ in range(600):
        name = "".join(rng.choice("ab0*é.+[]\n") for _ in range(rng.randint(0, 6)))
        assert [globs[i] for i in trie.match(name)] == [g for g in globs if glob_match(g, name)], name


@pytest.mark.parametrize("trie_bytes", [64, 1 << 20])
def test_paths_and_patterns(spark, trie_bytes):
    rng = random.Random(2)
    globs = some_globs(rng, 60)
    paths = ["/".join("".join(rng.choice("ab0.") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 4))) for _ in range(120)] + [None, "", "a/b"] * 2
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, i int").withColumn("name", F.lit("clash")).withColumn("own", F.lit(1))
    table = spark.createDataFrame([(g,) for g in [*globs, None, globs[0]]], "pattern string")
    got = {r["i"]: r["patterns"] for r in glob_tables.matching(frame, "path", table, trie_bytes).collect()}
    assert got == {i: sorted({g for g in globs if p is not None and any(glob_match(g, x) for x in p.split("/"))}) for i, p in enumerate(paths)}
    assert glob_tables.matching(frame.limit(0), "path", table).count() == 0
    assert glob_tables.matching(frame, "path", table.limit(0)).where(F.size("patterns") > 0).count() == 0


def test_ten_thousand_patterns(spark):
    frame = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id") % 50, F.lit("/f"), "id").alias("path"))
    table = spark.range(10_000).select(F.concat(F.lit("f"), F.col("id"), F.when(F.col("id") % 10 == 0, "?").otherwise("")).alias("pattern"))
    began = time.perf_counter()
    got = glob_tables.matching(frame, "path", table)
    want = {f"f{i}" for i in range(10_000) if i % 10} | {f"f{i}{d}" for i in range(0, 10_000, 10) for d in range(10)}
    assert got.where(F.size("patterns") > 0).count() == sum(f"f{i}" in want for i in range(20_000))
    assert time.perf_counter() - began < 120
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
