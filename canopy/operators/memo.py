"""Results that are kept by the content they were made from: only content that was never seen is computed.

A memo is a folder of Parquet files with a row for each different content (by its SHA-256): what was computed, and the run that
asked for it last. A run joins the hashes of its rows with the memo, computes the ones that are missing, once
each whatever number of rows has them, appends these, and joins the results back. Eviction rewrites the memo without what no
run has asked for lately. The results of an appended run are files that are never changed, so a failed run leaves the
memo as it was, or with more of what it would have computed anyway.

Cases: null content is content like any other, of its own hash; repeated rows share one computation; other columns pass through,
and of those named like a result the new ones replace the old; an empty table gives no rows and computes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.plans.lineage import checkpointed, ensure_checkpoint_dir

_HASH, _RUN = "__hash", "__run"


@dataclass
class Memo:
    """compute: from rows with `__hash` and content to rows with `__hash` and results, of the given schema."""

    spark: SparkSession
    compute: Callable[[DataFrame], DataFrame]
    results: T.StructType
    folder: str = ""
    runs: int = 0
    computed: list[int] = field(default_factory=list)  # contents that each run has computed

    def __post_init__(self):
        self.folder = self.folder or f"{ensure_checkpoint_dir(self.spark)}/memo-{uuid.uuid4().hex}"

    def _entries(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def known(self) -> DataFrame:
        return self._entries("entries", T.StructType([T.StructField(_HASH, T.StringType()), *self.results.fields]))

    @property
    def asked(self) -> DataFrame:
        return self._entries("asked", T.StructType([T.StructField(_HASH, T.StringType()), T.StructField(_RUN, T.IntegerType())]))

    def apply(self, rows: DataFrame, content: str) -> DataFrame:
        """All columns of rows, with the results of their content."""
        kept = [c for c in rows.columns if c not in self.results.fieldNames()]
        rows = rows.select(*kept).withColumn(_HASH, content_hash(F.col(content)))
        hashes = checkpointed(rows.groupBy(_HASH).agg(F.count("*").alias("n")))
        missing = checkpointed(hashes.join(self.known.select(_HASH), _HASH, "left_anti").select(_HASH))
        self.computed.append(missing.count())
        self.runs += 1
        if self.computed[-1]:
            fresh = rows.join(missing, _HASH, "left_semi").groupBy(_HASH).agg(F.first(content).alias("content"))
            self.compute(fresh).select(_HASH, *self.results.fieldNames()).write.mode("append").parquet(f"{self.folder}/entries")
        hashes.select(_HASH, F.lit(self.runs).alias(_RUN)).write.mode("append").parquet(f"{self.folder}/asked")
        return rows.join(self.known, _HASH).select(*kept, *self.results.fieldNames())

    def evict(self, runs: int) -> Memo:
        """The memo without what the last `runs` runs have not asked for, in a folder of its own."""
        own = Memo(self.spark, self.compute, self.results, runs=self.runs, computed=list(self.computed))
        recent = checkpointed(self.asked.groupBy(_HASH).agg(F.max(_RUN).alias(_RUN)).where(F.col(_RUN) > self.runs - runs))
        self.known.join(recent.select(_HASH), _HASH, "left_semi").write.parquet(f"{own.folder}/entries")
        recent.write.parquet(f"{own.folder}/asked")
        return own


def content_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content.cast("binary"), 256), F.lit(""))
