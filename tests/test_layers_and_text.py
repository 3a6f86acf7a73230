"""Layers against a dictionary that is changed step by step; text output against one ordered text."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import layers, text_output


@pytest.mark.parametrize("steps", [1, 20])
def test_layers_equal_changes_one_by_one(spark, monkeypatch, steps):
    monkeypatch.setattr(layers, "MOST", 6)
    rng = random.Random(steps)
    state = {(t, i): f"base{i}" for t in ("a", None) for i in range(30)}
    schema = "tree string, id int, text string"
    own = layers.Layers(spark.createDataFrame([(*k, v) for k, v in state.items()], schema), ("tree", "id"))
    depth = []
    for step in range(steps):
        keys = [(rng.choice(["a", None]), rng.randrange(40)) for _ in range(8)]
        changed = {k: f"step{step}" for k in keys[:5]}
        gone = [k for k in keys[5:] if k not in changed]
        own = own.add(spark.createDataFrame([(*k, v) for k, v in changed.items()], schema), spark.createDataFrame(gone, "tree string, id int"))
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        depth.append(own.read()._jdf.queryExecution().optimizedPlan().toString().count("Aggregate"))
    assert {(r["tree"], r["id"]): r["text"] for r in own.read().collect()} == state and own.read().columns == ["tree", "id", "text"]
    assert max(depth) == 1 and len(own.changes) <= 6  # one aggregation, whatever was laid over
    flat = own.compacted()
    assert not flat.changes and {(r["tree"], r["id"]): r["text"] for r in flat.read().collect()} == state
    assert own.add(own.base.limit(0)).read().count() == len(state)


def test_tombstones_and_ties(spark):
    base = spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], "key string, v int")
    own = layers.Layers(base, ("key",))
    assert sorted(map(tuple, own.add(base.limit(0)).read().collect()), key=str) == [("k", 2), (None, 3)]
    both = own.add(spark.createDataFrame([("k", 5)], "key string, v int"), spark.createDataFrame([("k",), (None,)], "key string"))
    assert [tuple(r) for r in both.read().collect()] == [("k", 5)]
    back = both.add(spark.createDataFrame([(None, None)], "key string, v int"))
    assert sorted(map(tuple, back.read().collect()), key=str) == [("k", 5), (None, None)]


@pytest.mark.parametrize(("block", "files"), [(3, 5), (1 << 17, 1)])
def test_parts_are_the_text_in_order(spark, tmp_path, block, files):
    rng = random.Random(block)
    rows = [(rng.randrange(50), f"t{i}", [rng.choice(["x", "y\nz", "", None]) for _ in range(rng.randint(0, 4))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "a int, b string, lines array<string>").withColumn("n", F.lit("clash"))
    numbered = text_output.numbered_lines(frame, ["a", "b"], F.col("lines"), block)
    text_output.write_lines(numbered, str(tmp_path / "out"), files)
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    got = "".join((tmp_path / "out" / p).read_text() for p in parts)
    want = [line for _, _, lines in sorted(rows, key=lambda r: r[:2]) for x in lines if x is not None for line in x.split("\n")]
    assert got == "".join(f"{i}: {line}\n" for i, line in enumerate(want, 1)) and len(parts) == files
    text_output.write_lines(text_output.numbered_lines(frame.limit(0), ["a"], F.col("lines")), str(tmp_path / "none"), 2)
    assert spark.read.text(str(tmp_path / "none")).count() == 0
