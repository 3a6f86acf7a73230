"""What the driver and each task do for trees of very many files."""

import os
import time

import pyarrow as pa
import pytest

from canopy.sources import gotree


def _left(stage: str) -> int:
    """Files that are staged, and not moved yet."""
    return sum(n.endswith(".go") for top, _, names in os.walk(stage) if os.path.join(stage, "tree") not in top for n in names)


def test_tasks_move_the_files_and_remove_them(spark, tmp_path, monkeypatch):
    root, seen, publish = str(tmp_path / "tree"), [], gotree._publish
    monkeypatch.setattr(gotree, "_publish", lambda root, stage: (seen.append(_left(stage)), publish(root, stage)))
    rows = [(f"s{i % 3}/l{i % 2}/f{i}.go", str(i).encode()) for i in range(60)]
    for mode in ("overwrite", "overwrite", "append"):
        gotree.write_tree(spark.createDataFrame(rows, "path string, content binary").repartition(4), root, mode, layout=False)
    assert seen == [0, 0, 0]  # nothing is left for the driver to move
    got = spark.read.format("gotree").option("path", root).load().select("path", "content").collect()
    assert sorted((r.path, bytes(r.content)) for r in got) == sorted(rows)
    assert os.listdir(tmp_path) == ["tree"]
    gotree.remove_tree(spark, root)
    assert os.listdir(tmp_path) == []


def test_moves_that_were_interrupted_are_finished(tmp_path):
    root = str(tmp_path / "tree")
    writer = gotree._Writer({"path": root, "layout": "false", "moves": "later"}, ["path", "content"], False)
    batch = lambda *names: iter([pa.RecordBatch.from_pydict({"path": list(names), "content": [n.encode() for n in names]})])
    done = [writer.write(batch("a/x.go", "b/y.go")), writer.write(batch("a/z.go", "w.go"))]
    writer.commit(done)
    assert not os.path.exists(root)
    gotree._move_of_stage(root, writer.stage, done[0].manifest)
    gotree._move_of_stage(root, writer.stage, done[0].manifest)  # a task that is run again
    gotree.recover(root)
    gotree._move_of_stage(root, writer.stage, done[1].manifest)  # one that comes too late
    assert sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names) == ["a/x.go", "a/z.go", "b/y.go", "w.go"]
    assert os.listdir(tmp_path) == ["tree"]


def test_a_large_directory_is_listed_few_times(tmp_path):
    (tmp_path / "src1").mkdir()
    for i in range(700):
        (tmp_path / "src1" / f"f{i}.go").touch()
    for batch in (None, "1"):
        reader = gotree._Reader({"path": str(tmp_path), "repo": "r"} | ({"batch": batch} if batch else {}))
        parts = reader.partitions()
        assert len(parts) == (64 if batch else 1)  # each of them lists the directory
        assert sorted(f for p in parts for f in reader._files(p)) == sorted(f"src1/f{i}.go" for i in range(700))


def _overwriter(root: str):
    batch = lambda rows: iter([pa.RecordBatch.from_pydict({"path": list(rows), "content": list(rows.values())})])
    writer = gotree._Writer({"path": root, "layout": "false", "moves": "later"}, ["path", "content"], True)
    return writer, lambda rows: writer.write(batch(rows))


def _contents(root: str) -> dict[str, bytes]:
    found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
    return {os.path.relpath(f, root): open(f, "rb").read() for f in found}


def test_a_new_tree_is_made_of_packs(tmp_path, monkeypatch):
    root, rows = str(tmp_path / "tree"), {f"s{i % 3}/f{i}.go": b"x" * i for i in range(50)} | {"top.go": b"t"}
    writer, write = _overwriter(root)
    done = [write(rows)]
    staged = [n for _, _, names in os.walk(writer.stage) for n in names]
    assert sorted(n.partition(".")[2] for n in staged) == ["manifest", "pack"]  # two files, not one for each row
    renames, real = [], os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: (renames.append((a, b)), real(a, b)))
    writer.commit(done)
    gotree._move_of_stage(root, writer.stage, done[0].manifest)
    made = [(a, b) for a, b in renames if b.endswith(".go")]
    assert len(made) == 51 and all(os.path.dirname(a) == os.path.dirname(b) for a, b in made)  # none waits for another folder's
    assert not os.path.exists(done[0].manifest.replace(".manifest", ".pack"))
    gotree.recover(root)
    assert _contents(root) == rows and os.listdir(tmp_path) == ["tree"]


def test_a_pack_that_was_interrupted_is_made_again(tmp_path, monkeypatch):
    root, rows = str(tmp_path / "tree"), {f"s{i % 3}/f{i}.go": str(i).encode() for i in range(9)}
    writer, write = _overwriter(root)
    done, real = [write(rows), write({"s0/other.go": b"o", "none.go": b""})], os.replace
    writer.commit(done)

    def stop(a, b):
        if b.endswith("f5.go"):
            raise OSError("killed here")
        real(a, b)

    monkeypatch.setattr(os, "replace", stop)
    for _ in range(2):
        with pytest.raises(OSError, match="killed"):
            gotree._move_of_stage(root, writer.stage, done[0].manifest)
    monkeypatch.setattr(os, "replace", real)
    assert not os.path.exists(root)  # nothing is visible
    gotree.recover(root)
    gotree._move_of_stage(root, writer.stage, done[1].manifest)  # one that comes too late
    assert _contents(root) == rows | {"s0/other.go": b"o", "none.go": b""} and os.listdir(tmp_path) == ["tree"]


@pytest.mark.parametrize("rows", [{"a.go": b"", "a.go/b.go": b""}, {"a/b/c.go": b"", "a": b""}, {f"{'n' * 300}.go": b""}, {"a\0.go": b""}, {".": b""}])
def test_what_no_tree_can_hold_fails_before_the_commit(tmp_path, rows):
    _, write = _overwriter(str(tmp_path / "tree"))
    with pytest.raises((OSError, ValueError)):
        write(rows)


def test_the_driver_lists_folders_by_few_threads(tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"src{i}").mkdir()
        (tmp_path / f"src{i}" / "f.go").touch()
    counted, inside, most = gotree._counted, [], []

    def slowly(*args):
        inside.append(1)
        most.append(len(inside))
        time.sleep(0.005)
        inside.pop()
        return counted(*args)

    monkeypatch.setattr(gotree, "_counted", slowly)
    assert len(gotree._Reader({"path": str(tmp_path), "repo": "r"}).partitions()) == 40
    assert max(most) <= 2  # sixteen took ten times as long over large folders, as they wait for Python's lock
