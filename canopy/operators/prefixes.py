"""The nearest ancestor of every path in a table of prefixes, by one ordered pass.

Paths and prefixes are sorted together, part by part of a path, so that what lies below a prefix follows it without a gap.
Ranges of this order are blocks (operators.ordered), and a task goes through a block once with a stack of the prefixes that
are open. A prefix of an earlier block that is open in a block lies above the block's first row; so the ancestors of
first rows, a few for each block, are looked up among the prefixes and carried in. Nothing else is exploded: the work
is linear in paths and prefixes, however deep they are, and any number of paths may lie below one prefix.

Cases: `.` and the empty path are the root, which is above everything of its tree; a path that is itself a prefix is its own
nearest; paths without one get nulls; null trees are trees; null paths lie below nothing; of a prefix that is given twice the
largest value counts; repeated paths are rows of their own; empty tables give no rows (no prefixes: nulls).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from canopy.operators.ordered import BLOCK, BLOCK_ROWS, PLACE, dealt, joined, small
from canopy.plans.lineage import checkpointed

_KEY, _KIND, _TREE, _PREFIX, _VALUE, _OPEN = "__key", "__kind", "__tree", "__prefix", "__value", "__open"


def _key(path: Column) -> Column:
    """Sorts what lies below a path right after it."""
    return F.when(path.isin("", "."), F.lit("")).otherwise(F.concat(F.replace(path, F.lit("/"), F.lit("\0")), F.lit("\0")))


def _matched(table: pa.Table, schema: pa.Schema, names: list[str]) -> pa.Table:
    """The paths of a block (sorted), with their nearest prefix."""
    table = table.sort_by([(_TREE, "ascending"), (_KEY, "ascending"), (_KIND, "ascending")])
    rows, prefixes, values = [], [], []
    tree, stack = None, []
    carried = next((x for x in table.column(_OPEN).to_pylist() if x), None) or []
    first = table.num_rows > 0
    columns = [table.column(c).to_pylist() for c in (_TREE, _KEY, _KIND, _PREFIX, _VALUE)]
    lowest = carried[0]["tree"] if carried else None
    for i, (own, key, kind, prefix, value) in enumerate(zip(*columns, strict=True)):
        if first or own != tree:
            stack = [(c["key"], c["prefix"], c["value"]) for c in carried] if carried and own == lowest else []
            tree, first = own, False
        if key is not None:
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
        if kind == 0:
            stack.append((key, prefix, value))
            continue
        rows.append(i)
        prefixes.append(stack[-1][1] if stack and key is not None else None)
        values.append(stack[-1][2] if stack and key is not None else None)
    kept = table.select(names).take(pa.array(rows, pa.int64()))
    return pa.Table.from_arrays([*kept.columns, pa.array(prefixes, pa.string()), pa.array(values, pa.string())], names=schema.names).cast(schema)


def nearest(paths: DataFrame, prefixes: DataFrame, tree: str, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of paths, with prefix and value (string) of the nearest row of prefixes (tree, prefix, value) at or above
    the path in its tree."""
    names = [c for c in paths.columns if c not in ("prefix", "value")]
    kept = paths.select(*names)
    # trees by a text of their own, so that null is one; what is not asked for is null in the rows of prefixes
    tree_text = lambda c: F.coalesce(F.concat(F.lit("t"), F.col(c).cast("string")), F.lit(""))
    own = prefixes.where("prefix is not null").groupBy(tree_text("tree").alias(_TREE), _key(F.col("prefix")).alias(_KEY)).agg(F.max(F.struct(F.col("value").cast("string").alias("v"), "prefix")).alias("p"))
    own = checkpointed(own.select(_TREE, _KEY, F.col("p.prefix").alias(_PREFIX), F.col("p.v").alias(_VALUE)))
    marks = own.select(*[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in names], _TREE, _KEY, F.lit(0).alias(_KIND), _PREFIX, _VALUE)
    asked = kept.select("*", tree_text(tree).alias(_TREE), _key(F.col(path)).alias(_KEY), F.lit(1).alias(_KIND), F.lit(None).cast("string").alias(_PREFIX), F.lit(None).cast("string").alias(_VALUE))
    placed = dealt(asked.unionByName(marks), [_TREE, _KEY, _KIND], block_rows)
    firsts = placed.groupBy(BLOCK).agg(F.min(F.struct(_TREE, _KEY)).alias("f")).select(BLOCK, F.col("f.*"))  # a row for each block
    ends = F.filter(F.sequence(F.lit(0), F.length(_KEY)), lambda i: (i == 0) | (F.substr(F.col(_KEY), i, F.lit(1)) == "\0"))
    above = firsts.select(BLOCK, _TREE, F.explode(F.transform(ends, lambda i: F.substr(F.col(_KEY), F.lit(1), i))).alias(_KEY))
    found = joined(above, own, [_TREE, _KEY]).groupBy(BLOCK).agg(F.array_sort(F.collect_list(F.struct(F.length(_KEY).alias("n"), F.col(_TREE).alias("tree"), F.col(_KEY).alias("key"), F.col(_PREFIX).alias("prefix"), F.col(_VALUE).alias("value")))).alias(_OPEN))
    rows = joined(placed, small(checkpointed(found)), [BLOCK], "left").drop(PLACE)
    out = kept.withColumns({"prefix": F.lit(None).cast("string"), "value": F.lit(None).cast("string")}).schema
    schema = to_arrow_schema(out)
    return rows.groupBy(BLOCK).applyInArrow(lambda t: _matched(t, schema, names), out)
