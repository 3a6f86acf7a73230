"""A budget of tokens for the rows of trees: less and less detail for a whole tree, then rows from its end.

Whole-tree totals choose the level of detail of each tree. Where even bare paths are too many, rows go from the end in order
of path; the cut is found by sums of blocks (operators.ordered), and only the one block in which a tree's sum passes
its budget is looked at row by row. So one tree of any size is cut by many tasks.

Cases: a null tree is a tree; equal paths are rows of their own, of which any may be cut first; the first row of a tree always
stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.ordered import BLOCK, BLOCK_ROWS, PLACE, block_offsets, dealt, joined, small
from canopy.plans.lineage import checkpointed

#: Bytes that count as a token.
TOKEN = 4


def within_budget(rows: DataFrame, budget: int | Column, costs: Sequence[Column], tree: str, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows that stay, with `level`: the first of the levels of detail whose bytes fit (costs: bytes of a row at each
    level, falling), or their number if none fits; then columns other than tree and path are null.

    budget: tokens; an expression may name total0, total1, ...: the bytes of a tree at each level."""
    if "level" in rows.columns:
        raise ValueError("rows have a column named level")
    names, most = rows.columns, len(costs)
    rows = checkpointed(rows)
    totals = rows.groupBy(tree).agg(*[F.sum(c).alias(f"total{i}") for i, c in enumerate(costs)])
    limit = F.lit(budget).cast("long") if isinstance(budget, int) else budget.cast("long")
    level = F.lit(most)
    for i in reversed(range(most)):
        level = F.when(F.floor(F.col(f"total{i}") / TOKEN) <= limit, F.lit(i)).otherwise(level)
    trees = checkpointed(totals.select(tree, level.alias("level"), (limit * TOKEN + TOKEN - 1).alias("__limit")))
    known = joined(rows, small(trees), [tree])
    bare = [F.col(c) if c in (tree, path) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    over = known.where(F.col("level") == most).select(*bare, costs[-1].cast("long").alias("__cost"), "__limit")
    placed = dealt(over, [tree, path], block_rows)
    blocks = block_offsets(placed, [tree], {"cost": F.col("__cost")})
    # blocks that begin within the limit, and every tree's first
    begun = small(checkpointed(joined(blocks, trees.select(tree, F.col("__limit").alias("__most")), [tree]).where("before_cost is null or before_cost <= __most").drop("__most")))
    reached = joined(placed, begun, [BLOCK, tree])
    before = F.coalesce("before_cost", F.lit(0))
    whole = reached.where(before + F.col("own_cost") <= F.col("__limit"))
    inside = Window.partitionBy(BLOCK, tree).orderBy(path, PLACE)
    sums = F.sum("__cost").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = reached.where(before + F.col("own_cost") > F.col("__limit"))
    cut = cut.withColumns({"__sum": before + sums, "__rank": F.row_number().over(inside)})
    cut = cut.where((F.col("__sum") <= F.col("__limit")) | (F.col("before_cost").isNull() & (F.col("__rank") == 1)))
    fits = known.where(F.col("level") < most).select(*names, "level")
    return fits.unionByName(whole.unionByName(cut.drop("__sum", "__rank")).select(*names, F.lit(most).alias("level")))
