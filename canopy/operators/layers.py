"""Overlays of overlays: a base and any number of layers of changes, merged when they are read.

Layers are kept side by side as rows with a version, and one aggregation picks the newest state of every key; so the
plan has the same depth after one layer and after fifty, and a layer costs its own rows when it is added. A row can be a tombstone,
after which the key is gone until a later layer brings it back. Aggregation is partial first, so a key that every
layer changes is thinned before the shuffle. `compacted` merges what there is into a new base.

Cases: null keys are keys like others; a key that the base or one layer holds several times keeps its largest row (by the
values in order of columns); equal versions are settled the same way, a tombstone losing; empty tables change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.plans.lineage import checkpointed

#: Layers after which add() merges the changes into one.
MOST = 16
VERSION, GONE = "version", "gone"


def merged(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str = VERSION, gone: str = GONE) -> DataFrame:
    """The rows of base as changes (its columns, a version, and whether the key is gone) leave them."""
    names = base.columns
    state = _newest(_stamped(base, version, gone).unionByName(changes.select(*names, version, gone)), names, keys, version, gone)
    return state.where(~F.col(gone)).select(*names)


def _stamped(base: DataFrame, version: str, gone: str) -> DataFrame:
    """Base rows are older than any layer."""
    return base.withColumns({version: F.lit(None).cast("long"), gone: F.lit(False)})


def _newest(rows: DataFrame, names: Sequence[str], keys: Sequence[str], version: str, gone: str) -> DataFrame:
    values = [c for c in names if c not in keys]
    order = F.struct(F.col(version).cast("long").alias("v"), (~F.col(gone)).alias("there"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(values)])
    newest = rows.groupBy(*keys).agg(F.max(order).alias("__s"))
    return newest.select(*[F.col(f"__s.c{values.index(c)}").alias(c) if c in values else F.col(c) for c in names], F.col("__s.v").alias(version), (~F.col("__s.there")).alias(gone))


@dataclass(frozen=True)
class Layers:
    """A base with layers over it; every change gives a new one."""

    base: DataFrame
    keys: tuple[str, ...]
    changes: tuple[DataFrame, ...] = ()
    top: int = 0

    def add(self, changed: DataFrame, removed: DataFrame | None = None) -> Layers:
        """With rows that are new or changed, and keys that go."""
        names = self.base.columns
        own = changed.select(*names).withColumns({VERSION: F.lit(self.top + 1).cast("long"), GONE: F.lit(False)})
        if removed is not None:
            lost = removed.select(*[F.col(c) if c in self.keys else F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in names])
            own = own.unionByName(lost.withColumns({VERSION: F.lit(self.top + 1).cast("long"), GONE: F.lit(True)}))
        changes = (*self.changes, own)
        if len(changes) > MOST:  # tombstones stay, as the base may hold their keys
            changes = (checkpointed(_newest(reduce(DataFrame.unionByName, changes), names, self.keys, VERSION, GONE).select(*names, VERSION, GONE)),)
        return replace(self, changes=changes, top=self.top + 1)

    def read(self) -> DataFrame:
        if not self.changes:
            return self.base
        return merged(self.base, reduce(DataFrame.unionByName, self.changes), self.keys)

    def compacted(self) -> Layers:
        """The same rows as a base by themselves."""
        return Layers(checkpointed(self.read()), self.keys)
