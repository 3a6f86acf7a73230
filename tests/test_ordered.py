"""Running sums and budgets by blocks against plain loops, with blocks of every size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import budget, ordered


def rows_of_trees(seed, n=300):
    rng = random.Random(seed)
    trees = ["hot"] * 6 + [f"t{i}" for i in range(9)] + [None]
    return [(rng.choice(trees), f"p{rng.randrange(80):02}", rng.choice([0, 1, 5, 30])) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_running_sums(spark, block):
    rows = rows_of_trees(block)
    frame = spark.createDataFrame(rows, "tree string, path string, cost long").withColumn("n", F.lit("kept"))
    got = ordered.running_sums(frame, ["tree"], ["path"], {"sum": F.col("cost"), "rank": F.lit(1)}, block_rows=block).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"tree", "path", "cost", "n", "sum", "rank"}
    for tree in {r[0] for r in rows}:
        own = sorted((r for r in got if r["tree"] == tree), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [r["path"] for r in own] == sorted(r["path"] for r in own)
        total = 0
        for r in own:
            total += r["cost"]
            assert r["sum"] == total
    assert ordered.running_sums(frame.limit(0), ["tree"], ["path"], {"sum": F.col("cost")}).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_budget_of_trees(spark, block):
    rows = rows_of_trees(block + 50)
    frame = spark.createDataFrame(rows, "tree string, path string, cost long").withColumn("more", F.col("cost") * 3)
    for limit in (0, 3, 25, 300):
        got = budget.within_budget(frame, limit, [F.col("more") + F.length("path"), F.length("path")], "tree", "path", block_rows=block).collect()
        for tree in {r[0] for r in rows}:
            own, kept = sorted(r[1] for r in rows if r[0] == tree), [r for r in got if r["tree"] == tree]
            if sum(3 * r[2] + 3 for r in rows if r[0] == tree) // 4 <= limit:
                level, want = 0, own
            elif 3 * len(own) // 4 <= limit:
                level, want = 1, own
            else:
                level, want = 2, own[: max(1, max(k for k in range(len(own)) if 3 * k // 4 <= limit))]
            assert sorted(r["path"] for r in kept) == want and {r["level"] for r in kept} == {level}
            assert all((r["cost"] is None) == (level == 2) for r in kept)
    assert budget.within_budget(frame.limit(0), 5, [F.col("cost")], "tree", "path").count() == 0


def test_one_tree_is_cut_by_many_blocks_of_which_one_is_sorted(spark):
    frame = spark.range(20_000).select(F.lit("t").alias("tree"), F.format_string("%08d", "id").alias("path"))
    placed = ordered.dealt(frame, ["tree", "path"], 1000)
    sizes = [r["count"] for r in placed.groupBy(ordered.BLOCK).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 4000
    kept = budget.within_budget(frame, 12_345, [F.length("path")], "tree", "path", block_rows=1000)
    assert sorted(r["path"] for r in kept.collect()) == [f"{i:08}" for i in range((12_345 * 4 + 3) // 8)]
