"""The tree source: filters that are pushed, listing by levels, writing all or nothing."""

from __future__ import annotations

import hashlib
import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.plans.corpus import Corpus
from canopy.sources import gotree

PATHS = ["a.go", "a_test.go", "go.mod", "x/b.go", "x/b_test.go", "x/y/c.go", "x/y/go.mod", "x/y/z/d.go", "xx/e.go", "é/f.go", "n.md", "vendor/v.go", ".h/h.go"]


@pytest.fixture
def tree(spark, tmp_path):
    rows = [(p, bytearray(f"package {i}\n".encode())) for i, p in enumerate(PATHS)]
    root = str(tmp_path / "tree")
    gotree.write_tree(spark.createDataFrame(rows, "path string, content binary").repartition(3), root, layout=False)
    assert sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names) == sorted(PATHS)
    assert os.listdir(tmp_path) == ["tree"]  # nothing that was staged is left
    return root


def load(spark, root, **options):
    return spark.read.format("gotree").options(path=root, repo="r", **options).load()


KEEPS = """
name = 'go.mod'; dir = 'x/y'; dir like 'x/%'; dir like 'x%'; dir in ('x', 'é'); not is_test; is_test; depth <= 1; depth < 1; depth >= 2; depth = 1; path = 'x/y/z/d.go'; path like 'x/y/%'
path like '%d.go'; repo = 'other'; not dir like 'x%'; name not in ('go.mod', 'a.go'); name like '%b%' and depth > 0; depth = 3 or name = 'a.go'; size > 10; depth in (0, 2); dir <=> 'x'; name is null
"""


def test_pushed_filters_give_what_filtering_gives(spark, tree):
    every = load(spark, tree).select("repo", "path", "dir", "name", "is_test", "depth", "size").toPandas()
    assert len(every) == 10
    local = spark.createDataFrame(every)
    for keep in KEEPS.strip().replace("\n", ";").split(";"):
        want = sorted(r["path"] for r in local.where(keep).collect())
        assert sorted(r["path"] for r in load(spark, tree, pushdown="true").where(keep).collect()) == want, keep


def test_what_does_not_match_is_neither_entered_nor_opened(spark, tree):
    secret, closed = os.path.join(tree, "x/b.go"), os.path.join(tree, "xx")
    os.replace(secret, secret + ".away")
    os.symlink(secret, secret)  # a link to itself cannot be opened
    rows = load(spark, tree, pushdown="true").where("name = 'go.mod'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["path"] for r in rows.collect()) == ["go.mod", "x/y/go.mod"] and "Filter (" not in plan  # the source took the filter over
    entered = []
    rules = gotree.Rules(filters=(gotree.ds.StringStartsWith(("dir",), "x/y"), gotree.ds.LessThanOrEqual(("depth",), 2)))
    entered = [folder for folder, _ in gotree.walk(tree, ".", 0, rules)]
    assert entered == [".", "x", "x/y"] and closed
    assert {r["module"] for r in Corpus.of_roots(spark, {"r": tree}).module_paths.collect()} == set()
    with pytest.raises(Exception, match="b.go"):
        load(spark, tree).collect()


def test_the_driver_lists_upper_folders_and_tasks_the_rest(spark, tree, monkeypatch):
    reader = gotree._Reader({"path": tree, "repo": "r", "batch": "1"})
    monkeypatch.setattr(gotree, "FOLDERS", 3)
    parts = reader.partitions()
    assert [(p.folder, p.below) for p in parts if p.below] == [("x", True), ("xx", True), ("é", True)] and sum(not p.below for p in parts) == 4  # n.md is a name too
    found = sorted(r for p in parts for b in reader.read(p) for r in b.column("path").to_pylist())
    assert found == sorted(p for p in PATHS if not p.startswith(("vendor", ".h")) and p != "n.md")


def test_a_failed_task_leaves_nothing_visible(spark, tree, tmp_path):
    def fail(batches):
        for batch in batches:
            if "boom" in batch.column("path").to_pylist():
                raise RuntimeError("boom")
            yield batch

    rows = spark.createDataFrame([(f"new/{i}.go", bytearray(b"x")) for i in range(20)] + [("boom", bytearray(b""))], "path string, content binary").repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="boom"):
            gotree.write_tree(rows.mapInArrow(fail, rows.schema), tree, mode, layout=False)
        assert not os.path.exists(os.path.join(tree, "new")) and os.path.exists(os.path.join(tree, "a.go"))
        for _ in range(20):  # other tasks of the job may still be at work
            if os.listdir(tmp_path) == ["tree"]:
                break
            time.sleep(0.5)
        assert os.listdir(tmp_path) == ["tree"]
    with pytest.raises(Exception, match="not a path"):
        gotree.write_tree(spark.createDataFrame([("../out.go", bytearray(b""))], "path string, content binary"), tree)
    assert not (tmp_path / "out.go").exists()


def test_modes_and_hashes(spark, tree):
    more = spark.createDataFrame([("a.go", bytearray(b"second")), ("q/w.go", bytearray(b""))], "path string, content binary")
    gotree.write_tree(more, tree, layout=False)
    read = lambda: {r["path"]: r["h"] for r in load(spark, tree).select("path", F.sha2("content", 256).alias("h")).collect()}
    assert len(read()) == 11 and read()["a.go"] == hashlib.sha256(b"second").hexdigest()
    gotree.write_tree(more, tree, "overwrite", layout=False)
    assert read() == {"a.go": hashlib.sha256(b"second").hexdigest(), "q/w.go": hashlib.sha256(b"").hexdigest()}
    gotree.write_tree(more.limit(0), tree, "overwrite")
    assert read() == {} and os.path.isdir(tree)


@pytest.mark.parametrize("overwrite", [False, True])
def test_an_interrupted_commit_is_finished_by_the_next_reader(spark, tree, overwrite, monkeypatch):
    writer = gotree._Writer({"path": tree, "layout": "false"}, ["path", "content"], overwrite)
    batches = [pa.RecordBatch.from_pydict({"path": [f"late/{k}.go", f"late/{k}b.go"], "content": [b"1", b"2"]}) for k in range(3)]
    staged = [writer.write(iter([b])) for b in batches]
    lost = writer.write(iter(batches[:1]))  # an attempt that does not count
    assert len(load(spark, tree).collect()) == 10 and lost.files == 2
    moved, real = [], os.replace

    def stop(source, target):
        if "late" in target:
            if len(moved) == 2:
                raise OSError("the driver dies here")
            moved.append(target)
        real(source, target)

    monkeypatch.setattr(os, "replace", stop)
    with pytest.raises(OSError, match="dies"):
        writer.commit(staged)
    writer.abort(staged)  # what is committed is not taken back
    monkeypatch.setattr(os, "replace", real)
    rows = {r["path"] for r in load(spark, tree).collect()}
    assert {p for p in rows if p.startswith("late/")} == {f"late/{k}{b}.go" for k in range(3) for b in ("", "b")} and len(rows) == (6 if overwrite else 16)
    assert os.listdir(os.path.dirname(tree)) == ["tree"]
    assert json.dumps(sorted(rows))
