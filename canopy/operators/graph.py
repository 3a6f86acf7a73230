"""The package map of a corpus: directories with their files, exported symbols, summaries and dependencies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import columns as c
from canopy.functions.globs import glob_match, glob_pattern
from canopy.operators.budget import within_budget as limited
from canopy.plans.corpus import Corpus


@dataclass(frozen=True)
class GraphOptions:
    dir: str = "."
    symbols: bool = False
    summary: bool = False
    deps: bool = False
    recursive: bool = False
    tests: bool = False
    depth: int = 0
    focus: str = ""
    exclude: tuple[str, ...] = ()
    token_budget: int = 0
    module: str = ""

    def implied(self) -> GraphOptions:
        """A focus implies symbols and summary, over the whole tree."""
        return replace(self, symbols=True, summary=True, recursive=True) if self.focus else self


def _below(path: Column, folder: str) -> Column:
    return F.lit(True) if folder == "." else (path == folder) | F.startswith(path, F.lit(folder + "/"))


def scanned(files: DataFrame, o: GraphOptions) -> DataFrame:
    """The Go files that a walk from o.dir would visit; files has dir, name, is_test."""
    rows = files if o.tests else files.where("not is_test")
    if o.symbols and not o.recursive:
        return rows.where(F.col("dir") == o.dir)  # one directory, whatever is excluded
    root = "." if o.dir == "." else o.dir.rsplit("/", 1)[-1]
    if root == "vendor" or any(glob_match(p, root) for p in o.exclude):
        return rows.where(F.lit(False))
    rows = rows.where(_below(F.col("dir"), o.dir))
    inner = F.col("dir") if o.dir == "." else F.substring(F.col("dir"), len(o.dir) + 2, 1 << 30)
    parts = F.when(F.col("dir") == o.dir, F.array().cast("array<string>")).otherwise(F.split(inner, "/"))
    bad: Column = F.exists(parts, lambda p: (p == "vendor") | F.startswith(p, F.lit(".")))
    patterns = [p for p in map(glob_pattern, o.exclude) if p is not None]
    if patterns:
        bad = bad | F.exists(parts, lambda p: p.rlike("^(?:" + "|".join(patterns) + ")$"))
    if o.depth:
        bad = bad | (F.size(parts) > o.depth)
    return rows.where(~bad)


def package_files(files: DataFrame, o: GraphOptions) -> DataFrame:
    """repo, dir of every directory with files."""
    return scanned(files, o).select("repo", "dir").distinct()


def summaries(corpus: Corpus, o: GraphOptions) -> DataFrame:
    """repo, dir, summary: from doc.go, else from the first production file."""
    rows = scanned(corpus.pkg_clause, o).where("not is_test")
    chosen = F.min_by(F.when(F.col("header_ok"), F.col("pkg_doc")).otherwise(F.lit("")), F.struct(F.col("name") != "doc.go", F.col("path")))
    return rows.groupBy("repo", "dir").agg(c.package_summary(chosen).alias("summary"))


def module_of(corpus: Corpus, folder: str = ".") -> DataFrame:
    """repo, module: the nearest module file at or above a directory."""
    above = corpus.module_paths.where((F.col("dir") == ".") | (F.lit(folder) == F.col("dir")) | F.startswith(F.lit(folder), F.concat("dir", F.lit("/"))))
    nearest = F.when(F.col("dir") == ".", F.lit(0)).otherwise(F.length("dir"))
    return above.groupBy("repo").agg(F.max_by("module", nearest).alias("module"))


def dependency_edges(corpus: Corpus, o: GraphOptions) -> DataFrame:
    """repo, dir, dep: distinct imports of the tree's own packages from production files."""
    rows = scanned(corpus.imports, o).where("not is_test")
    return rows.join(module_of(corpus, o.dir), "repo").select("repo", "dir", c.dependency(F.col("import_path"), F.col("module")).alias("dep")).where("dep is not null").distinct()


def dependencies(corpus: Corpus, o: GraphOptions) -> DataFrame:
    """repo, dir, deps (sorted; directories without any have no row)."""
    return dependency_edges(corpus, o).groupBy("repo", "dir").agg(F.array_sort(F.collect_set("dep")).alias("deps"))


def shown_symbols(o: GraphOptions) -> Column:
    """The symbols that a parsed file shows; one that failed shows a warning."""
    shown = F.filter("decls", lambda d: d["exported"] | (F.lit(o.tests) & F.col("is_test")))
    texts = F.transform(shown, lambda d: c.graph_signature(F.col("content"), d))
    warning = F.array(F.concat(F.lit("WARNING: failed to parse: "), F.col("path"), F.lit(":"), F.col("parse_error")))
    return F.when(F.col("parse_ok"), texts).otherwise(warning)


def file_symbols(corpus: Corpus, o: GraphOptions) -> DataFrame:
    """repo, dir, path, symbols of every file that shows any, in order of declaration."""
    return scanned(corpus.parsed, o).select("repo", "dir", "path", shown_symbols(o).alias("symbols")).where(F.size("symbols") > 0)


def _packages(corpus: Corpus, o: GraphOptions) -> DataFrame:
    """repo, dir, files, summary, deps of every directory with files, by one pass over what was scanned as far as needed."""
    listed = "array<struct<path:string,symbols:array<string>>>"
    if not (o.symbols or o.summary or o.deps):
        return package_files(corpus.go_files, o).select("repo", "dir", F.lit(None).cast(listed).alias("files"), F.lit("").alias("summary"), F.lit(None).cast("array<string>").alias("deps"))
    parsed = corpus.parsed if o.symbols else corpus.headers if o.deps else corpus.clauses
    rows = scanned(parsed, o).withColumn("shown", shown_symbols(o) if o.symbols else F.lit(None).cast("array<string>"))
    if o.deps:
        rows = rows.join(F.broadcast(module_of(corpus, o.dir)), "repo", "left")  # one row a tree
        own = F.when(F.col("imports_ok") & ~F.col("is_test"), F.transform("imports", lambda i: c.dependency(i["import_path"], F.col("module"))))
        rows = rows.withColumn("own", F.filter(own, lambda d: d.isNotNull()))
    else:
        rows = rows.withColumn("own", F.lit(None).cast("array<string>"))
    first = F.when(~F.col("is_test"), F.struct(F.col("name") != "doc.go", F.col("path")))
    grouped = rows.groupBy("repo", "dir").agg(
        F.array_sort(F.collect_list(F.when(F.size("shown") > 0, F.struct("path", F.col("shown").alias("symbols"))))).alias("files"),
        F.min_by(F.when(F.col("clause_ok"), F.col("package_doc")).otherwise(F.lit("")), first).alias("doc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("deps"),
    )
    summary = F.coalesce(c.package_summary(F.col("doc")), F.lit("")) if o.summary else F.lit("")
    return grouped.select("repo", "dir", F.when(F.size("files") > 0, F.col("files")).cast(listed).alias("files"), summary.alias("summary"), F.when(F.size("deps") > 0, F.col("deps")).alias("deps"))


def graph(corpus: Corpus, options: GraphOptions) -> DataFrame:
    """repo, ord, path, files (path, symbols), summary, deps (null if none), in order of path."""
    if options.module:
        corpus = corpus.module(options.module)
    o = options
    if not options.module:
        recursive = not o.symbols or o.recursive
        pushed = {"dir": o.dir, "tests": str(o.tests).lower(), "recursive": str(recursive).lower()}
        if recursive and not any("," in p for p in o.exclude):
            pushed |= {"exclude": ",".join(o.exclude), "depth": str(o.depth)}
        corpus = corpus.narrowed(**pushed)
    focused = F.lit(True) if not o.focus else (F.col("path") == o.focus) | F.startswith(F.col("path"), F.lit(o.focus + "/"))
    rows = _packages(corpus, o)
    rows = rows.withColumnRenamed("dir", "path")
    rows = rows.select(
        "repo",
        "path",
        F.when(focused, F.col("files")).alias("files"),
        F.when(focused, F.coalesce("summary", F.lit(""))).otherwise(F.lit("")).alias("summary"),
        F.when(focused, F.col("deps")).alias("deps"),
    )
    if o.token_budget > 0:
        rows = within_budget(rows, o.token_budget)
    # packages are numbered within their tree: rows are packages, not files
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("path")))
    if corpus.header:
        head = rows.select("repo").distinct().select(
            "repo", F.lit(corpus.header).alias("path"), F.lit(None).cast(rows.schema["files"].dataType).alias("files"), F.lit("").alias("summary"), F.lit(None).cast("array<string>").alias("deps"), F.lit(0).alias("ord")
        )
        rows = head.unionByName(rows)
    return rows.select("repo", "ord", "path", "files", "summary", "deps")


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Give up summaries, then dependencies, symbols, files, until a tree's bytes / 4 fit; then packages
    from the end, but never the first."""
    details = ((True, True, True, True), (False, True, True, True), (False, False, True, True), (False, False, False, True), (False, False, False, False))
    kept = limited(rows, budget, [c.package_bytes(*d) for d in details], "repo", "path")
    bare = F.transform("files", lambda f: F.struct(f["path"].alias("path"), F.lit(None).cast("array<string>").alias("symbols")))
    return kept.select(
        "repo",
        "path",
        F.when(F.col("level") < 3, F.col("files")).when(F.col("level") == 3, bare).alias("files"),
        F.when(F.col("level") < 1, F.col("summary")).otherwise(F.lit("")).alias("summary"),
        F.when(F.col("level") < 2, F.col("deps")).alias("deps"),
    )


def sub_packages(corpus: Corpus, folder: str = ".") -> DataFrame:
    """repo, name of the direct child directories that hold a Go file, sorted."""
    prefix = "" if folder == "." else folder + "/"
    inner = F.substring(F.col("dir"), len(prefix) + 1, 1 << 30)
    children = corpus.go_files.where((F.col("dir") != folder) & (F.col("dir") != ".") & F.startswith(F.col("dir"), F.lit(prefix)))
    return children.select("repo", inner.alias("name")).where(~F.col("name").contains("/")).distinct().orderBy("repo", "name")
