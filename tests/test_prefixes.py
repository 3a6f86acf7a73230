"""Nearest prefixes against a look at every ancestor."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import prefixes


def naive(paths, known):
    best = {}
    for tree, prefix, value in known:
        if prefix is not None:
            at = (tree, "" if prefix == "." else prefix)
            best[at] = max(best.get(at, ("", "")), (value or "", prefix))
    out = []
    for tree, path, n in paths:
        found = None
        if path is not None:
            parts = [] if path in ("", ".") else path.split("/")
            found = next((best[tree, "/".join(parts[:k])] for k in range(len(parts), -1, -1) if (tree, "/".join(parts[:k])) in best), None)
        out.append((tree, path, n, found and found[1], found and found[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 40, 1 << 17])
def test_nearest_prefixes(spark, block):
    rng = random.Random(block)
    name = lambda: rng.choice(["a", "b", "a b", "a-", "é", "a0"])
    path = lambda most: "/".join(name() for _ in range(rng.randint(1, most)))
    trees = ["s", "t", "", None]
    paths = [(rng.choice(trees), rng.choice([path(6), path(6), None, ".", ""]), i) for i in range(250)]
    known = list({(rng.choice(trees), rng.choice([path(3), path(5), "."])): None for _ in range(80)})
    known = [(t, p, f"v{i}") for i, (t, p) in enumerate(known)] + [("s", None, "x")]
    frame = spark.createDataFrame(paths, "tree string, path string, n int").withColumn("value", F.lit("clash"))
    table = spark.createDataFrame(known, "tree string, prefix string, value string")
    got = prefixes.nearest(frame, table, "tree", "path", block)
    assert got.columns == ["tree", "path", "n", "prefix", "value"]
    assert sorted(map(tuple, got.collect()), key=str) == naive(paths, known)


def test_deep_paths_and_empty_tables(spark):
    deep = "/".join(["d"] * 2000)
    frame = spark.createDataFrame([("t", f"{deep}/{i}") for i in range(200)], "tree string, path string")
    table = spark.createDataFrame([("t", "d", "1"), ("t", deep, "2"), ("t", f"{deep}/7", "3"), ("u", ".", "4")], "tree string, prefix string, value string")
    got = prefixes.nearest(frame, table, "tree", "path", 50).groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in got} == {"2": 199, "3": 1}
    assert prefixes.nearest(frame, table.limit(0), "tree", "path").where("prefix is null").count() == 200
    assert prefixes.nearest(frame.limit(0), table, "tree", "path").count() == 0
