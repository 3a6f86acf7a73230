"""Lookups that read a small share of the index, and results that are computed once for each content."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators import name_index
from canopy.operators.memo import Memo


def scanned_rows(frame):
    """Rows that the scan of a plan gave, after it has run."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_lookup_reads_a_small_share(spark):
    rows = spark.range(200_000).select(F.format_string("Symbol%07d", F.col("id") % 150_000).alias("name"), "id", F.md5(F.col("id").cast("string")).alias("more"))
    index = name_index.build(rows, least_buckets=16)
    names = spark.createDataFrame([("Symbol0000007",), ("Symbol0123456",), ("none",), (None,), ("Symbol0000007",)], "name string")
    found = index.lookup(names)
    assert sorted(r["id"] for r in found.collect()) == [7, 123456, 150007]
    read = scanned_rows(found)
    assert 3 <= read <= 3 / 16 * 200_000  # three of sixteen buckets at most, and of these not all pages
    assert "In(name" in found._jdf.queryExecution().executedPlan().toString()
    many = index.lookup(spark.range(5000).select(F.format_string("Symbol%07d", F.col("id") * 2).alias("name")))
    assert many.count() == 10_000 and index.lookup(names.limit(0)).count() == 0
    index.drop()
    empty = name_index.build(rows.limit(0))
    assert empty.lookup(names).count() == 0
    empty.drop()


def test_only_new_content_is_computed(spark):
    schema = T.StructType([T.StructField("words", T.IntegerType())])
    memo = Memo(spark, lambda rows: rows.select("__hash", F.size(F.split("content", " ")).alias("words")), schema)
    base = spark.range(1000).select("id", F.concat(F.lit("text "), (F.col("id") % 500).cast("string")).alias("text"), F.lit("x").alias("words"))
    want = lambda rows: {r["id"]: None if r["text"] is None else len(r["text"].split(" ")) for r in rows.collect()}
    got = lambda rows: {r["id"]: r["words"] for r in memo.apply(rows, "text").collect()}
    assert got(base) == want(base) and memo.computed == [500]
    changed = base.withColumn("text", F.when(F.col("id") % 100 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    assert got(changed) == want(changed) and memo.computed == [500, 5]  # 1 % of the rows, half of them alike
    assert got(base.limit(0)) == {} and memo.computed == [500, 5, 0]
    memo = memo.evict(1)
    assert got(changed) == want(changed) and memo.computed[-1] == 500  # the last run had asked for nothing
    memo = memo.evict(1)
    nulls = base.withColumn("text", F.when(F.col("id") > 5, F.col("text")))
    assert got(nulls) == want(nulls) and memo.computed[-1] == 6  # null, and five contents that only the first run had
