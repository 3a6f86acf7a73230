"""Lines in order as text files that all tasks write: numbered across the files, the parts in order the whole text.

A row may give several lines. How many lines precede a row is a running sum by blocks (operators.ordered); then rows are dealt
over files by ranges of these numbers, evenly, and every file is sorted by itself. Nothing is collected.

Cases: null lines are no lines; a line break inside a line makes two; repeated rows give repeated lines; an empty table gives
files without lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.ordered import BLOCK_ROWS, running_sums


def numbered_lines(rows: DataFrame, order: Sequence[str], lines: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """number (from 1), line: the lines (an array of strings) of the rows in order."""
    own = F.split(F.array_join(lines, "\n"), "\n")
    rows = rows.where(F.size(F.filter(lines, lambda x: x.isNotNull())) > 0)
    rows = rows.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], own.alias("lines")).withColumn("n", F.size("lines").cast("long"))
    placed = running_sums(rows, [], [f"o{i}" for i in range(len(order))], {"through": F.col("n")}, block_rows)
    return placed.select((F.col("through") - F.col("n")).alias("before"), F.posexplode("lines").alias("at", "line")).select((F.col("before") + F.col("at") + 1).alias("number"), "line")


def write_lines(numbered: DataFrame, folder: str, files: int, show_numbers: bool = True) -> None:
    """Write lines (number, line) as so many text files, of which the names are in the order of the text."""
    text = F.concat(F.col("number").cast("string"), F.lit(": "), F.col("line")) if show_numbers else F.col("line")
    numbered.repartitionByRange(files, "number").sortWithinPartitions("number").select(text.alias("value")).write.mode("overwrite").text(folder)
