"""Orders over whole tables without a window over a whole table: ranges of rows, their totals, offsets joined back.

Rows are dealt over blocks by ranges of their order, so that a block holds about BLOCK_ROWS rows whatever the
keys are: one key with a billion rows has thousands of blocks, a thousand small keys share one. Sums over what
precedes a row are then those of the earlier blocks (a table with a row for each block and key) and those inside the block.

Blocks are written to the shared checkpoint folder with the place of each row, since ranges come from a sample and would
be others if they were drawn again after the loss of an executor. Equal rows are told apart by a number, so any number of
them can be spread. Null keys are keys like others; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.plans.lineage import checkpointed

#: Rows of a block, which one task sorts; rows of a table that is broadcast.
BLOCK_ROWS, BROADCAST_ROWS = 1 << 17, 1 << 18
BLOCK, PLACE = "__block", "__place"


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows (written before), to be broadcast if they are few enough; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns of one name, nulls being equal; the columns of left, then the others of right."""
    renamed = right.withColumnsRenamed({n: f"__right_{i}" for i, n in enumerate(names)})
    condition = F.lit(True)
    for i, name in enumerate(names):
        condition = condition & F.col(name).eqNullSafe(F.col(f"__right_{i}"))
    return left.join(renamed, condition, how).drop(*[f"__right_{i}" for i in range(len(names))])


def dealt(rows: DataFrame, order: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with BLOCK, ascending ranges of the order, and PLACE, which tells equal rows apart."""
    rows = checkpointed(rows.withColumn(PLACE, F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // block_rows))
    return checkpointed(rows.repartitionByRange(blocks, *order, PLACE).withColumn(BLOCK, F.spark_partition_id()))


def block_offsets(placed: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """BLOCK, keys, and of each value its sum in the block (own_) and in the key's earlier blocks (before_; null in the
    key's first block): a row for each block, and one more for each key that begins inside a block."""
    totals = placed.groupBy(BLOCK, *keys).agg(*[F.sum(v).alias(f"own_{name}") for name, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # rows are blocks
    return checkpointed(totals.withColumns({f"before_{name}": F.sum(f"own_{name}").over(earlier) for name in values}))


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of rows and, by name, the sum of each value over the rows of the same keys up to this one in order."""
    placed = dealt(rows, [*keys, *order], block_rows)
    offsets = small(block_offsets(placed, keys, values))
    inside = Window.partitionBy(BLOCK, *keys).orderBy(*order, PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = joined(placed.withColumns({f"inside_{name}": F.sum(v).over(inside) for name, v in values.items()}), offsets, [BLOCK, *keys])
    return summed.select(*rows.columns, *[(F.coalesce(f"before_{name}", F.lit(0)) + F.col(f"inside_{name}")).alias(name) for name in values])
