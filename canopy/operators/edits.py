"""Edits of trees as transformations: each gives the changed files as a new DataFrame and what happened.

Nothing is changed in place. `overlay` lays changed files over a corpus, so that further queries read them;
`sources.gotree.write_tree` writes them out. Edits of one tree are sequential, because offsets move with
every edit; trees are edited side by side. Only the directories that a plan touches are shipped.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import gotext as g
from canopy.functions.edit_rules import Action, Outcome, Tree
from canopy.operators.layers import Layers
from canopy.plans import schemas
from canopy.plans.corpus import Corpus
from canopy.plans.lineage import checkpointed
from canopy.sources.gotree import write_tree

_RESULT_SCHEMA = "repo string, kind string, path string, content binary, files_modified int, warnings array<string>, messages array<string>, failed_seq int, error_code string, error_message string"
Edit = Callable[[Tree, list[tuple[int, Action]]], Outcome]


def _folder(path: Column) -> Column:
    place = F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)
    return F.when(place == "", F.lit(".")).otherwise(place)


def _apply(corpus: Corpus, actions: DataFrame, edit: Edit) -> tuple[DataFrame, DataFrame]:
    """Fold the actions of each repo over the files of the directories that they name."""
    named = actions.select("repo", F.explode(F.filter(F.array("file", "mock_file"), lambda p: p.isNotNull() & (p != ""))).alias("p"))
    touched = named.select("repo", _folder(F.regexp_replace("p", r"^\./", "")).alias("dir")).distinct()
    files = corpus.go_files.join(touched, ["repo", "dir"], "left_semi").select("repo", "path", "content")

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        repo = rows[0]["repo"] if rows else left["repo"][0].as_py()
        tree = Tree(dict(zip(left["path"].to_pylist(), left["content"].to_pylist(), strict=True)), repo)
        if not rows:
            return pa.Table.from_pylist([], schema=_RESULT_ARROW)
        todo = [(r["seq"], Action(**{k: r[k] if r[k] is not None else (False if k == "strip_doc" else "") for k in r if k not in ("repo", "seq")})) for r in rows]
        out = edit(tree, todo)
        made = [{"repo": repo, "kind": "file", "path": p, "content": tree.files[p]} for p in sorted(tree.changed)]
        done = {"repo": repo, "kind": "outcome"} | vars(out)
        return pa.Table.from_pylist([*made, done], schema=_RESULT_ARROW)

    both = checkpointed(files.groupBy("repo").cogroup(actions.groupBy("repo")).applyInArrow(fold, _RESULT_SCHEMA))
    changed = both.where("kind = 'file'").select("repo", "path", "content")
    outcomes = both.where("kind = 'outcome'").select("repo", "files_modified", "warnings", "messages", "failed_seq", "error_code", "error_message")
    return changed, outcomes


_RESULT_ARROW = pa.schema(
    [
        ("repo", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("files_modified", pa.int32()), ("warnings", pa.list_(pa.string())),
        ("messages", pa.list_(pa.string())), ("failed_seq", pa.int32()), ("error_code", pa.string()), ("error_message", pa.string()),
    ]
)


def execute_plan(corpus: Corpus, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed files and one outcome per repo. Actions run by seq; the first failure stops its repo, and
    earlier edits stay. A plan without actions is an error."""
    if plan.isEmpty():
        raise g.EmptyPlan("plan has no actions")
    return _apply(corpus, plan, lambda tree, actions: tree.run(actions))


def run_action(corpus: Corpus, action: Action, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One action on one repo (the only one, if none is named)."""
    return execute_plan(corpus, actions_frame(corpus, [action], repo))


def actions_frame(corpus: Corpus, actions: list[Action], repo: str | None = None) -> DataFrame:
    """The actions as rows: for one tree, or for every tree of the corpus."""
    rows = [tuple([repo, i] + [getattr(a, k) for k in schemas.ACTIONS.fieldNames()[2:]]) for i, a in enumerate(actions)]
    if repo is not None or not rows:
        return corpus.spark.createDataFrame(rows, schemas.ACTIONS)
    names = [f for f in schemas.ACTIONS.fields if f.name != "repo"]
    listed = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(names, row[1:], strict=True)]) for row in rows])
    trees = corpus.files.select(F.concat("repo", F.lit("")).alias("repo")).distinct()  # a column of its own: plans meet the files again
    return trees.select("repo", F.explode(listed).alias("a")).select("repo", "a.*")


def _command(corpus: Corpus, path: str, repo: str | None, run: Callable[[Tree], str], other: str = "") -> tuple[DataFrame, DataFrame]:
    def edit(tree: Tree, actions: list[tuple[int, Action]]) -> Outcome:
        out = Outcome()
        try:
            out.messages.append(run(tree))
            out.files_modified = len(tree.changed)
        except g.EngineError as e:
            out.failed_seq, out.error_code, out.error_message = 0, e.code, e.message
        return out

    return _apply(corpus, actions_frame(corpus, [Action("", path, mock_file=other)], repo), edit)


def tag_struct(corpus: Corpus, path: str, struct: str, field: str = "", set_tag: str = "", auto: str = "", repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Set or merge struct tags: exactly for one field, or merged into all, or by the fields' names."""
    return _command(corpus, path, repo, lambda tree: tree.tag(path, struct, field, set_tag, auto))


def generate_test(corpus: Corpus, path: str, identifier: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append a table-driven skeleton to the test file beside a file."""
    return _command(corpus, path, repo, lambda tree: tree.test(path, identifier))


def extract_interface(corpus: Corpus, path: str, struct: str, name: str, out: str = "", mock_file: str = "", mock_name: str = "", repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Declare an interface of a struct's exported methods, and a mock of it if asked for."""

    def edit(tree: Tree) -> str:
        return tree.extract(path, struct, name, out, mock_file, mock_name)

    def run(tree: Tree, actions: list[tuple[int, Action]]) -> Outcome:
        result = Outcome()
        try:
            result.messages.append(edit(tree))
            result.files_modified = 1
        except g.EngineError as e:
            result.failed_seq, result.error_code, result.error_message = 0, e.code, e.message
        return result

    shipped = [Action("", path, mock_file=mock_file), Action("", out or path)]
    return _apply(corpus, actions_frame(corpus, shipped, repo), run)


def add_interface(corpus: Corpus, path: str, content: str, mock_file: str = "", mock_name: str = "", repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    return run_action(corpus, Action("add_interface", path, content=content, mock_file=mock_file, mock_name=mock_name), repo)


def update_interface(
    corpus: Corpus, path: str, identifier: str, content: str, mock_file: str = "", mock_name: str = "", doc: str = "", strip_doc: bool = False, repo: str | None = None
) -> tuple[DataFrame, DataFrame]:
    return run_action(corpus, Action("update_interface", path, "", identifier, content, mock_file, mock_name, doc, strip_doc), repo)


def delete_interface(corpus: Corpus, path: str, identifier: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    return run_action(corpus, Action("delete_interface", path, identifier=identifier), repo)


def total_modified(outcomes: list[DataFrame]) -> DataFrame:
    """files_modified summed over the plans of one call."""
    from functools import reduce

    return reduce(DataFrame.unionByName, outcomes).agg(F.coalesce(F.sum("files_modified"), F.lit(0)).alias("files_modified"))


def overlay(corpus: Corpus, changed: DataFrame) -> Corpus:
    """The corpus as it reads with changed files laid over it. Overlays of overlays are layers of one base, so that
    reading takes one aggregation, however many there are."""
    layers = corpus.layers or Layers(corpus.files.select("repo", "path", "content"), ("repo", "path"))
    layers = layers.add(changed)
    own = Corpus.of_files(layers.read(), corpus.modules)
    own.layers = layers
    return own


def unified_diff(corpus: Corpus, changed: DataFrame) -> DataFrame:
    """repo, path, diff of every changed file, three lines of context, in order of path."""
    new = changed.select("repo", "path", F.col("content").alias("new"))
    rows = new.join(corpus.files.select("repo", "path", F.col("content").alias("old")), ["repo", "path"], "left")
    schema = "repo string, path string, diff string"
    arrow = pa.schema([("repo", pa.string()), ("path", pa.string()), ("diff", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                old, fresh = ((x or b"").decode("utf-8", "replace").splitlines(keepends=True) for x in (r["old"], r["new"]))
                out.append({"repo": r["repo"], "path": r["path"], "diff": "".join(difflib.unified_diff(old, fresh, f"a/{r['path']}", f"b/{r['path']}", n=3))})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select("repo", "path", "old", "new").mapInArrow(run, schema).where("diff <> ''").orderBy("repo", "path")


#: What a verb does to each kind of object.
VERBS = {
    "create": {"file": "create_file", "func": "add_func", "struct": "add_struct"},
    "update": {"file": "replace_file", "func": "update_func", "struct": "update_struct"},
    "delete": {"func": "delete_func", "struct": "delete_struct"},
}


def _verb(verb: str, kind: str) -> str:
    if kind not in VERBS[verb]:
        raise g.EngineError("INVALID_ACTION", f"cannot {verb} {kind!r}; one of {', '.join(VERBS[verb])}")
    return VERBS[verb][kind]


def create(corpus: Corpus, kind: str, path: str, content: str, package: str = "", repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Create a file, or add a func or struct."""
    return run_action(corpus, Action(_verb("create", kind), path, package, content=content), repo)


def update(corpus: Corpus, kind: str, path: str, content: str, identifier: str = "", doc: str = "", strip_doc: bool = False, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a file, func or struct."""
    return run_action(corpus, Action(_verb("update", kind), path, "", identifier, content, doc=doc, strip_doc=strip_doc), repo)


def delete(corpus: Corpus, kind: str, path: str, identifier: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Delete a func, or a struct with its methods in the same file."""
    return run_action(corpus, Action(_verb("delete", kind), path, identifier=identifier), repo)


def settle(corpus: Corpus, changed: DataFrame, mode: str = "plan", root: str = "") -> Corpus | DataFrame:
    """What becomes of changed files: `plan` lays them over the corpus, `diff` shows them, `write` saves
    them below a shared root (and lays them over)."""
    if mode == "diff":
        return unified_diff(corpus, changed)
    if mode == "write":
        write_tree(changed, root)
    elif mode != "plan":
        raise g.EngineError("INVALID_ACTION", f"unknown mode {mode!r}")
    return overlay(corpus, changed)
