"""A kept index of names: bucketed and sorted by name, with Bloom filters, so that a lookup opens few files and few pages.

`build` writes rows once; afterwards a lookup of some names reads only the buckets that they hash to, and inside them only the
row groups and pages whose Bloom filters, ranges and column indexes let one be in. Lookups of very many names
join by bucket, without a shuffle of the index.

Cases: null names are kept and never found; repeated rows are found as often as they were given; names that are not in the
index give nothing; an empty index or lookup gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.plans.lineage import ensure_checkpoint_dir

#: Rows of a bucket on average, bytes of a row group, and names that are looked up by pruning.
BUCKET_ROWS, GROUP_BYTES, PRUNED_NAMES = 1 << 20, 1 << 20, 1000


@dataclass(frozen=True)
class NameIndex:
    spark: SparkSession
    table: str

    def lookup(self, names: DataFrame) -> DataFrame:
        """The rows of the index with a name among those of `names` (column name)."""
        wanted = names.where("name is not null").select("name").distinct()
        few = [r["name"] for r in wanted.limit(PRUNED_NAMES + 1).collect()]
        rows = self.spark.table(self.table)
        if len(few) <= PRUNED_NAMES:
            return rows.where(F.col("name").isin(few)) if few else rows.limit(0)
        return rows.join(wanted, "name", "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def build(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, least_buckets: int = 8) -> NameIndex:
    """An index of rows by their column name, in the folder that driver and executors share."""
    spark, table = rows.sparkSession, f"names_{uuid.uuid4().hex}"
    buckets = max(least_buckets, -(-rows.count() // bucket_rows))
    # dealt as the buckets are, so that a bucket is one file; a hot name is one file that grows, and splits when read
    writer = rows.repartition(buckets, "name").write.format("parquet").bucketBy(buckets, "name").sortBy("name")
    options = {"parquet.bloom.filter.enabled#name": "true", "parquet.bloom.filter.expected.ndv#name": "100000", "parquet.block.size": str(GROUP_BYTES), "path": f"{ensure_checkpoint_dir(spark)}/{table}"}
    writer.options(**options).saveAsTable(table)
    return NameIndex(spark, table)
