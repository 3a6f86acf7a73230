"""A batch data source for trees of Go source: lists and reads them, and writes all of a DataFrame's files or none.

    register(spark)
    spark.read.format("gotree").option("path", root).load()
    changed.write.format("gotree").mode("append").option("path", root).save()

Reading gives repo, path (relative to the root), dir (`.` for the root), name, is_test, depth (of dir), size, content.
Listing prunes while it walks: `vendor`, directories that start with a dot (not the root) and, if asked for, excluded
globs and depth. Files and directories that start with an underscore are kept, and so are files that start
with a dot. Linked directories are not followed. Options: path (several roots: separated by the path
separator), repo (names, likewise), dir (only this directory of each tree, with the module files above it), recursive, tests,
exclude (globs, comma-separated), depth (below dir), errors (fail or skip), batch (files of one directory a task; more, if that makes over SHARES tasks),
content (false: null contents, nothing is read), pushdown.

With pushdown=true filters on repo, path, dir, name, is_test and depth are pushed into the source: directories that cannot hold a match are not
entered, files that do not match are not opened. The driver lists the upper directories only, level by level, until
it has FOLDERS of them (it keeps their names, and numbers of files); tasks list what is below, and read it. (Spark keeps the pushed filters of a loaded table in one place for all its uses; so
a plan that filters it in two ways has to load it twice, and the option is off unless asked for.)

Writing takes path and content of a row (Go files in their formatter's layout; option layout=false: as they are). Every
attempt of a task stages its files beside the root, with a manifest of path, size and hash: in a folder of its own, or, in mode
overwrite, one after the other in one file, its pack.
Only when all tasks are done a commit record names the manifests of the attempts that count; then (by the tasks of another job in write_tree(), else by the driver) the files are
moved to their places, or, in mode overwrite, a new tree is made of the packs and takes the root's place. Without the record nothing is
visible and an abort removes what was staged; with it, a commit that was interrupted is finished by whoever reads
or writes the tree next. Of rows with one path any one is kept.

The roots must be visible to the driver and to the executors: a shared folder. Trees that are elsewhere enter as rows,
through Corpus.of_files.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import stat
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext, suppress
from dataclasses import dataclass
from typing import TextIO
from zlib import crc32

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from canopy.functions.globs import glob_match
from canopy.functions.goformat import formatted

#: Bytes of a batch of rows on its way to the executor; directories that the driver lists at least, if there are so many.
ROWS_BYTES, FOLDERS = 4 << 20, 256
#: Files of one directory a task, and tasks of one directory at most: each of them lists the whole directory.
BATCH, SHARES = 1024, 64
#: Threads that list folders on the driver: they hand over Python's lock at every file, and more of them mostly wait for it.
LISTERS = 2
SCHEMA = "repo string, path string, dir string, name string, is_test boolean, depth int, size long, content binary"
MODULE_FILE = "go.mod"
_COLUMNS = ("repo", "path", "dir", "name", "is_test", "depth")


@dataclass
class _Part(ds.InputPartition):
    """Files of one folder (every `of`-th by hash), or of all that is below it too."""

    repo: str
    root: str
    top: str  # the folder of the tree that options.dir names
    folder: str  # in the tree
    level: int  # below top
    below: bool
    part: int = 0
    of: int = 1

    def __post_init__(self):
        self.value = self.folder


@dataclass(frozen=True)
class Rules:
    """What a walk keeps: options, and filters that were pushed."""

    recursive: bool = True
    tests: bool = True
    exclude: tuple[str, ...] = ()
    depth: int = 0
    skip_errors: bool = False
    filters: tuple[ds.Filter, ...] = ()

    def enters(self, name: str, folder: str, level: int) -> bool:
        """Whether a folder (of a level below the top) is listed."""
        if name == "vendor" or name.startswith(".") or any(glob_match(p, name) for p in self.exclude) or (self.depth and level > self.depth):
            return False
        return all(_may_hold(f, folder) for f in self.filters)

    def keeps(self, repo: str, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        if name != MODULE_FILE and not (name.endswith(".go") and (self.tests or not name.endswith("_test.go"))):
            return False
        row = _described(repo, path)
        return all(_holds(f, row) for f in self.filters)


def _described(repo: str, path: str) -> dict:
    folder, _, name = path.rpartition("/")
    return {"repo": repo, "path": path, "dir": folder or ".", "name": name, "is_test": path.endswith("_test.go"), "depth": folder.count("/") + 1 if folder else 0}


def _supported(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return isinstance(f.child, ds.EqualTo | ds.In | ds.StringStartsWith | ds.StringEndsWith | ds.StringContains) and _supported(f.child)
    known = ds.EqualTo | ds.EqualNullSafe | ds.In | ds.IsNotNull | ds.StringStartsWith | ds.StringEndsWith | ds.StringContains | ds.LessThan | ds.LessThanOrEqual | ds.GreaterThan | ds.GreaterThanOrEqual
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS and getattr(f, "value", 0) is not None and None not in (f.value if isinstance(f, ds.In) else ())


def _holds(f: ds.Filter, row: dict) -> bool:
    """A filter on a row without nulls."""
    if isinstance(f, ds.Not):
        return not _holds(f.child, row)
    own = row[f.attribute[0]]
    match f:
        case ds.IsNotNull():
            return True
        case ds.EqualTo() | ds.EqualNullSafe():
            return own == f.value
        case ds.In():
            return own in f.value
        case ds.StringStartsWith():
            return own.startswith(f.value)
        case ds.StringEndsWith():
            return own.endswith(f.value)
        case ds.StringContains():
            return f.value in own
        case ds.LessThan():
            return own < f.value
        case ds.LessThanOrEqual():
            return own <= f.value
        case ds.GreaterThan():
            return own > f.value
    return own >= f.value


def _may_hold(f: ds.Filter, folder: str) -> bool:
    """Whether a folder, or one below it, can hold a file that a filter lets pass. Strings are compared as code
    points here; only equality and beginnings decide, so order is of no matter."""
    if isinstance(f, ds.Not):
        return True
    column, inner = f.attribute[0], folder + "/"
    if column in ("dir", "path"):
        match f:
            case ds.EqualTo() | ds.EqualNullSafe():
                return f.value == folder or f.value.startswith(inner)
            case ds.In():
                return any(v == folder or v.startswith(inner) for v in f.value)
            case ds.StringStartsWith():
                return inner.startswith(f.value) or folder.startswith(f.value) or f.value.startswith(inner)
    if column == "depth":
        level = folder.count("/") + 1
        match f:
            case ds.EqualTo() | ds.EqualNullSafe() | ds.LessThanOrEqual():
                return level <= f.value
            case ds.LessThan():
                return level < f.value
            case ds.In():
                return any(level <= v for v in f.value)
    return True


def _joined(folder: str, name: str) -> str:
    return name if folder == "." else f"{folder}/{name}"


def _is_folder(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir()
    except OSError:
        return False  # a link that leads nowhere; reading says so


def _listed(root: str, folder: str, rules: Rules) -> tuple[list[str], list[str]]:
    """Names of the files and of the directories in a folder of a tree, sorted."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = [(e.name, e.is_dir(follow_symlinks=False), _is_folder(e)) for e in found]
    except OSError:
        if not rules.skip_errors:
            raise
        return [], []
    return sorted(n for n, _, folder_like in entries if not folder_like), sorted(n for n, own, _ in entries if own)


def _counted(root: str, folder: str, rules: Rules) -> tuple[int, list[str]]:
    """Number of the files, and names of the directories in a folder of a tree, sorted: the driver holds no names of files."""
    files, folders = 0, []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.name)
                elif not _is_folder(e):
                    files += 1
    except OSError:
        if not rules.skip_errors:
            raise
        return 0, []
    return files, sorted(folders)


def _share(p: _Part, rules: Rules) -> list[str]:
    """Names of the files in a part's folder that are its own, sorted."""
    try:
        with os.scandir(os.path.join(p.root, p.folder)) as found:
            return sorted(e.name for e in found if (p.of == 1 or crc32(e.name.encode(errors="surrogateescape")) % p.of == p.part) and not _is_folder(e))
    except OSError:
        if not rules.skip_errors:
            raise
        return []


def walk(root: str, folder: str, level: int, rules: Rules) -> Iterator[tuple[str, list[str]]]:
    """(folder, names of its files) from a folder of a tree down, pruned on the way."""
    names, folders = _listed(root, folder, rules)
    yield folder, names
    if rules.recursive:
        for name in folders:
            inner = _joined(folder, name)
            if rules.enters(name, inner, level + 1):
                yield from walk(root, inner, level + 1, rules)


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.content = flag("content", "true")
        exclude = tuple(p for p in options.get("exclude", "").split(",") if p)
        self.rules = Rules(flag("recursive", "true"), flag("tests", "true"), exclude, int(options.get("depth", "0")), options.get("errors") == "skip")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        if self.options.get("pushdown", "false").lower() != "true":
            return filters
        taken = [f for f in filters if _supported(f)]
        self.rules = Rules(**{k: v for k, v in vars(self.rules).items() if k != "filters"}, filters=(*self.rules.filters, *taken))
        return [f for f in filters if not _supported(f)]

    def partitions(self) -> list[_Part]:
        o, rules = self.options, self.rules
        roots = o["path"].split(os.pathsep)
        repos = o["repo"].split(os.pathsep) if o.get("repo") else [os.path.basename(os.path.abspath(r)) for r in roots]
        top, most = os.path.normpath(o.get("dir", ".")), int(o.get("batch", BATCH))
        out: list[_Part] = []
        frontier: list[_Part] = []
        for repo, root in zip(repos, roots, strict=True):
            recover(root)
            if not all(_holds(f, {"repo": repo}) for f in rules.filters if not isinstance(f, ds.Not) and f.attribute == ("repo",)):
                continue
            base = os.path.basename(top) if top != "." else os.path.basename(os.path.abspath(root))
            above = [os.path.join(*top.split("/")[:k], "") if k else "." for k in range(top.count("/") + 1)] if top != "." else []
            out += [_Part(repo, root, top, os.path.normpath(f), 0, False, 0, 0) for f in above]  # module files only
            if not (rules.recursive and (base == "vendor" or any(glob_match(p, base) for p in rules.exclude))):
                frontier.append(_Part(repo, root, top, top, 0, True))
        with ThreadPoolExecutor(LISTERS) as threads:
            while frontier and len(frontier) < FOLDERS:  # one level of all trees at a time
                level, frontier = frontier, []
                for at, (files, folders) in zip(level, threads.map(lambda p: _counted(p.root, p.folder, rules), level), strict=True):
                    parts = min(SHARES, -(-files // most))
                    out += [_Part(at.repo, at.root, top, at.folder, at.level, False, k, parts) for k in range(parts)]
                    inner = [(name, _joined(at.folder, name)) for name in folders] if rules.recursive else []
                    frontier += [_Part(at.repo, at.root, top, folder, at.level + 1, True) for name, folder in inner if rules.enters(name, folder, at.level + 1)]
        return [*out, *frontier] or [_Part("", "", ".", ".", 0, False, 0, -1)]

    def _files(self, p: _Part) -> Iterator[str]:
        if p.of < 0:
            return
        if p.of == 0:  # above the top: the module file
            path = _joined(p.folder, MODULE_FILE)
            if os.path.isfile(os.path.join(p.root, path)):
                yield path
            return
        for folder, names in walk(p.root, p.folder, p.level, self.rules) if p.below else [(p.folder, _share(p, self.rules))]:
            yield from (_joined(folder, name) for name in names)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds = {"repo": pa.string(), "path": pa.string(), "dir": pa.string(), "name": pa.string(), "is_test": pa.bool_(), "depth": pa.int32(), "size": pa.int64(), "content": pa.binary()}
        schema, rows, held = pa.schema(list(kinds.items())), [], 0
        for path in self._files(partition):
            if not self.rules.keeps(partition.repo, path):
                continue
            try:
                full = os.path.join(partition.root, path)
                content = None
                if self.content:
                    with open(full, "rb") as f:
                        content = f.read()
                size = len(content) if content is not None else os.path.getsize(full)
            except OSError:
                if not self.rules.skip_errors:
                    raise
                continue
            rows.append(_described(partition.repo, path) | {"size": size, "content": content})
            held += 100 + (size if content is not None else 0)
            if held > ROWS_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


# -- writing ---------------------------------------------------------------------------------------------------
@dataclass
class _Staged(ds.WriterCommitMessage):
    manifest: str
    files: int


def _stages(root: str) -> tuple[str, str]:
    """Folder and name prefix of what is staged for a root."""
    full = os.path.abspath(root)
    return os.path.dirname(full), f".{os.path.basename(full)}.staged-"


class _Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        for name in ("path", "content"):
            if name not in columns:
                raise ValueError(f"rows to write need a column {name}")
        self.root, self.layout, self.overwrite = options["path"], options.get("layout", "true").lower() == "true", overwrite
        self.moves_later = options.get("moves") == "later"
        parent, prefix = _stages(self.root)
        self.stage = os.path.join(parent, prefix + uuid.uuid4().hex)
        os.makedirs(self.stage)  # on the driver; tasks that outlive an abort do not make it again

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        own = os.path.join(self.stage, uuid.uuid4().hex)  # of this attempt
        os.mkdir(own)
        count, made = 0, set()
        with open(f"{own}.part", "w+", encoding="utf-8") as manifest, open(f"{own}.pack", "wb") if self.overwrite else nullcontext() as pack:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if not path or os.path.isabs(path) or ".." in path.split("/"):
                        raise ValueError(f"not a path inside a tree: {path!r}")
                    data = content.encode() if isinstance(content, str) else content or b""
                    data = formatted(data) if self.layout and path.endswith(".go") else data
                    target = os.path.join(own, os.path.normpath(path))
                    if (folder := os.path.dirname(target)) not in made and os.path.isdir(own):
                        os.makedirs(folder, mode=0o755, exist_ok=True)
                        made.add(folder)
                    if pack is not None:
                        _check_name(target)
                        pack.write(data)
                    else:
                        with open(target, "wb") as f:
                            f.write(data)
                    manifest.write(json.dumps([os.path.normpath(path), len(data), hashlib.sha256(data).hexdigest()]) + "\n")
                    count += 1
            manifest.flush()
            if pack is not None:
                _check_folders(manifest, own, made)
            os.fsync(manifest.fileno())
        os.replace(f"{own}.part", f"{own}.manifest")
        return _Staged(f"{own}.manifest", count)

    def commit(self, messages: list[_Staged | None]) -> None:
        record = os.path.join(self.stage, "COMMIT")
        with open(f"{record}.part", "w", encoding="utf-8") as f:
            json.dump({"overwrite": self.overwrite, "manifests": [m.manifest for m in messages if m is not None]}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{record}.part", record)  # from here on the files belong to the tree
        if not self.moves_later:
            _publish(self.root, self.stage)

    def abort(self, messages: list[_Staged | None]) -> None:
        if not os.path.exists(os.path.join(self.stage, "COMMIT")):
            shutil.rmtree(self.stage, ignore_errors=True)


def _check_name(target: str) -> None:
    """Fail, before anything is committed, where a file of this name could not be made."""
    with suppress(FileNotFoundError):
        if stat.S_ISDIR(os.lstat(target).st_mode):
            raise IsADirectoryError(target)


def _check_folders(manifest: TextIO, own: str, made: set[str]) -> None:
    """Fail where a file of an attempt is a folder of another one."""
    folders = {own}
    for folder in made:
        while folder not in folders:
            folders.add(folder)
            folder = os.path.dirname(folder)
    manifest.seek(0)
    for line in manifest:  # not held
        if (target := os.path.join(own, json.loads(line)[0])) in folders:
            raise IsADirectoryError(target)


def _target(root: str, stage: str, record: dict) -> str:
    return os.path.join(stage, "tree") if record["overwrite"] else root


def _move(manifest: str, target: str) -> None:
    """Move the files of one attempt to their places; what was moved before, or is by somebody else just now, is left out."""
    own, made = manifest.removesuffix(".manifest"), set()
    if os.path.exists(f"{own}.moved"):
        return
    if os.path.exists(f"{own}.pack"):
        _unpack(manifest, target)
        return
    with open(manifest, encoding="utf-8") as lines:  # not held
        for line in lines:
            path = json.loads(line)[0]
            staged, final = os.path.join(own, path), os.path.join(target, path)
            if (folder := os.path.dirname(final)) not in made:
                if not os.path.exists(staged):
                    continue
                os.makedirs(folder, mode=0o755, exist_ok=True)
                made.add(folder)
            with suppress(FileNotFoundError):
                os.replace(staged, final)
    open(f"{own}.moved", "w").close()
    shutil.rmtree(own, ignore_errors=True)


def _unpack(manifest: str, target: str) -> None:
    """Make the files of one attempt's pack in a new tree, which nobody reads yet: a file gets its name when it is whole, and
    the rename stays in its folder (those between folders wait for each other, all over a file system)."""
    own, made = manifest.removesuffix(".manifest"), set()
    mark, again = f".{os.path.basename(own)}.", os.path.exists(f"{own}.begun")
    name = f"{mark}{uuid.uuid4().hex}"  # somebody else may do the same just now
    try:
        open(f"{own}.begun", "w").close()
        with open(f"{own}.pack", "rb") as pack, open(manifest, encoding="utf-8") as lines:
            for line in lines:
                path, size, _ = json.loads(line)
                final, data = os.path.join(target, path), pack.read(size)
                if len(data) != size:
                    raise OSError(f"{own}.pack is cut short")
                if (folder := os.path.dirname(final)) not in made:
                    if not os.path.exists(f"{own}.pack"):
                        return  # somebody else has made them all
                    os.makedirs(folder, mode=0o755, exist_ok=True)
                    made.add(folder)
                whole = os.path.join(folder, name)
                with open(whole, "wb") as f:
                    f.write(data)
                with suppress(FileNotFoundError):  # removed by somebody else, after all files were made
                    os.replace(whole, final)
        for folder in made if again else ():  # what an interrupted run has left
            for left in os.listdir(folder):
                if left.startswith(mark):
                    with suppress(FileNotFoundError):
                        os.remove(os.path.join(folder, left))
    except FileNotFoundError:
        if os.path.exists(f"{own}.pack"):
            raise
        return
    open(f"{own}.moved", "w").close()
    with suppress(FileNotFoundError):
        os.remove(f"{own}.pack")
    shutil.rmtree(own, ignore_errors=True)


def _move_of_stage(root: str, stage: str, manifest: str) -> None:
    """_move() by a task; nothing if somebody else has finished the stage."""
    with suppress(FileNotFoundError):
        with open(os.path.join(stage, "COMMIT"), encoding="utf-8") as f:
            record = json.load(f)
        if not os.path.exists(os.path.join(stage, "DONE")):
            _move(manifest, _target(root, stage, record))


def _publish(root: str, stage: str) -> None:
    """Move the files of a committed stage to their places; may be repeated after an interruption at any point."""
    if not os.path.exists(os.path.join(stage, "COMMIT")):
        return  # somebody else has finished it
    with open(os.path.join(stage, "COMMIT"), encoding="utf-8") as f:
        record = json.load(f)
    target = _target(root, stage, record)
    done = os.path.join(stage, "DONE")
    if not os.path.exists(done):
        os.makedirs(target, exist_ok=True)
        with ThreadPoolExecutor(16) as threads:
            list(threads.map(lambda m: _move(m, target), record["manifests"]))
        open(done, "w").close()
    if record["overwrite"] and os.path.isdir(target):
        old = os.path.join(stage, "old")
        if os.path.isdir(root) and not os.path.isdir(old):
            os.replace(root, old)
        os.replace(target, root)
    shutil.rmtree(stage, ignore_errors=True)


def _committed(root: str) -> list[str]:
    """Stages of a root that are committed, and not finished."""
    parent, prefix = _stages(root)
    names = sorted(os.listdir(parent)) if os.path.isdir(parent) else []
    return [os.path.join(parent, n) for n in names if n.startswith(prefix) and os.path.exists(os.path.join(parent, n, "COMMIT"))]


def recover(root: str) -> None:
    """Finish the commits to a tree that were interrupted."""
    for stage in _committed(root):
        _publish(root, stage)


class GoTree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "gotree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        return _Writer(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GoTree)


def write_tree(files, root: str, mode: str = "append", layout: bool = True) -> None:
    """Write files (path, content) below a shared root, all of them or none; Go files in their formatter's layout."""
    register(files.sparkSession)
    files.select("path", "content").write.format("gotree").mode(mode).option("path", root).option("layout", str(layout).lower()).option("moves", "later").save()
    for stage in _committed(root):
        with open(os.path.join(stage, "COMMIT"), encoding="utf-8") as f:
            manifests = json.load(f)["manifests"]  # one of each task
        if manifests:
            files.sparkSession.sparkContext.parallelize(manifests, len(manifests)).foreach(lambda m, stage=stage: _move_of_stage(root, stage, m))
        _publish(root, stage)


def remove_tree(spark: SparkSession, root: str) -> None:
    """Remove a tree: folders below the upper ones by tasks, the rest by the driver."""
    frontier, rules = ["."], Rules(skip_errors=True)
    while frontier and len(frontier) < FOLDERS:
        inner = [_joined(folder, name) for folder in frontier for name in _counted(root, folder, rules)[1]]
        if not inner:
            break
        frontier = inner
    if frontier != ["."]:
        spark.sparkContext.parallelize(frontier, len(frontier)).foreach(lambda folder: shutil.rmtree(os.path.join(root, folder), ignore_errors=True))
    shutil.rmtree(root)
