"""A handle over source trees: the files as rows, parsed once, and the tables that come from the parse."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from canopy.functions.goscan import Field, SourceFile, scan
from canopy.plans import schemas
from canopy.sources import gotree


def _typed(fields: list[Field]) -> list[dict]:
    return [{"names": f.names, "type_src": f.type_src, "variadic": f.variadic} for f in fields]


def parsed_row(repo: str, path: str, content: bytes, level: str = "full") -> dict:
    """One row of schemas.PARSED."""
    found: SourceFile = scan(content, level)
    decls = []
    for i, d in enumerate(found.decls if not found.error else []):
        row = {k: v for k, v in asdict(replace(d, fields=[], members=[], params=[], results=[])).items() if k in schemas.DECL.fieldNames()}
        row |= {
            "ord": i,
            "fields": [{k: getattr(f, k) for k in schemas.FIELD.fieldNames()} for f in d.fields],
            "members": [{"method": m.method, "type_src": m.type_src, "params": _typed(m.params), "results": _typed(m.results)} for m in d.members],
            "params": _typed(d.params),
            "results": _typed(d.results),
        }
        decls.append(row)
    return {
        "repo": repo, "path": path, "content": content, "package": found.package, "package_doc": found.package_doc, "clause_ok": found.clause_ok,
        "imports_ok": found.imports_ok, "parse_ok": not found.error, "parse_error": found.error,
        "imports": [{"ord": i, "import_path": m.path, "alias": m.alias} for i, m in enumerate(found.imports)], "decls": decls,
    }


def parse(files: DataFrame, level: str = "full") -> DataFrame:
    """Scan every Go file once; level `imports` or `package` reads headers only."""
    schema = to_arrow_schema(schemas.PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for low in range(0, len(rows), 128):
                yield pa.RecordBatch.from_pylist([parsed_row(r["repo"], r["path"], r["content"] or b"", level) for r in rows[low : low + 128]], schema=schema)

    return files.select("repo", "path", "content").mapInArrow(run, schemas.PARSED)


def _placed(rows: DataFrame) -> DataFrame:
    if {"dir", "name", "is_test"} <= set(rows.columns):  # by the source, into which filters on them are pushed
        return rows
    place = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    return rows.withColumns(
        {"dir": F.when(place == "", F.lit(".")).otherwise(place), "name": F.substring_index("path", "/", -1), "is_test": F.col("path").endswith("_test.go")}
    )


class Corpus:
    """Many trees side by side; every table has `repo`, and paths are relative to the tree."""

    def __init__(self, files: DataFrame, modules: DataFrame | None = None, placed: bool = False):
        spark = files.sparkSession
        self.spark: SparkSession = spark
        self.files = _placed(files.select("repo", "path", "content", *(("dir", "name", "is_test") if placed else ())))
        self.modules = modules if modules is not None else spark.createDataFrame([], schemas.MODULES)

    # -- sources ----------------------------------------------------------------------------------
    @classmethod
    def of_files(cls, files: DataFrame, modules: DataFrame | None = None) -> Corpus:
        """Rows of repo, path, content (binary)."""
        return cls(files, modules)

    @classmethod
    def of_texts(cls, spark: SparkSession, trees: dict[str, dict[str, str]], modules: DataFrame | None = None) -> Corpus:
        rows = [(repo, path, bytearray(text.encode())) for repo, files in trees.items() for path, text in files.items()]
        return cls(spark.createDataFrame(rows, schemas.FILES), modules)

    @classmethod
    def of_roots(cls, spark: SparkSession, roots: dict[str, str], modules: DataFrame | None = None, **options: str) -> Corpus:
        """Trees in a folder that driver and executors share; options as in sources.gotree."""
        import os

        gotree.register(spark)
        reader = spark.read.format("gotree").option("path", os.pathsep.join(roots.values())).option("repo", os.pathsep.join(roots))
        own = cls(reader.options(**options).load(), modules, placed=True)
        own.origin = (roots, options)
        return own

    def narrowed(self, **options: str) -> Corpus:
        """The same trees, with options of the source that leave out files; only where they are read from it."""
        if self.origin is None or self.cached:
            return self
        roots, own = self.origin
        return Corpus.of_roots(self.spark, roots, self.modules, **(options | own))

    # -- tables -----------------------------------------------------------------------------------
    @cached_property
    def go_files(self) -> DataFrame:
        return self.files.where(F.col("name").endswith(".go"))

    @cached_property
    def parsed(self) -> DataFrame:
        """One row per Go file with everything the scan found; the scan runs once while this is cached."""
        return _placed(parse(self.go_files))

    @cached_property
    def headers(self) -> DataFrame:
        """As parsed, but what follows the imports is not scanned (and not found), unless `parsed` is kept anyway."""
        return self.parsed if self.cached else _placed(parse(self.go_files, "imports"))

    @cached_property
    def clauses(self) -> DataFrame:
        """As parsed, up to the package clause."""
        return self.parsed if self.cached else _placed(parse(self.go_files, "package"))

    def cache(self) -> Corpus:
        self.parsed.persist()
        self.cached = True
        return self

    @cached_property
    def pkg_clause(self) -> DataFrame:
        return self.clauses.select("repo", "path", "dir", "name", "is_test", "package", F.col("package_doc").alias("pkg_doc"), F.col("clause_ok").alias("header_ok"))

    @cached_property
    def imports(self) -> DataFrame:
        return self.headers.where("imports_ok").select("repo", "path", "dir", "is_test", F.explode("imports").alias("i")).select("repo", "path", "dir", "is_test", "i.*")

    @cached_property
    def decls(self) -> DataFrame:
        return self.parsed.select("repo", "path", "dir", "name", "is_test", "package", "content", F.explode("decls").alias("d")).withColumnRenamed("name", "file_name")

    @cached_property
    def fields(self) -> DataFrame:
        return self.decls.select("repo", "path", F.col("d.ord").alias("decl_ord"), F.posexplode("d.fields").alias("ord", "f")).select("repo", "path", "decl_ord", "ord", "f.*")

    @cached_property
    def iface_members(self) -> DataFrame:
        rows = self.decls.where("d.type_kind = 'interface'")
        return rows.select("repo", "path", "dir", F.col("d.ord").alias("decl_ord"), "package", F.col("d.name").alias("iface"), F.posexplode("d.members").alias("ord", "m")).select(
            "repo", "path", "dir", "decl_ord", "package", "iface", "ord", "m.*"
        )

    @cached_property
    def module_paths(self) -> DataFrame:
        """repo, dir, module: what each module file declares."""
        line = F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^[ \t]*module[ \t]+(.*?)\s*$", 1)
        files = self.files
        if self.origin is not None:  # a table of its own, of which the source opens module files alone
            roots, options = self.origin
            files = Corpus.of_roots(self.spark, roots, **(options | {"pushdown": "true"})).files
        return files.where("name = 'go.mod'").select("repo", "dir", line.alias("module")).where("module <> ''")

    def only(self, repo: str | None = None) -> Corpus:
        """One tree: the one named, or the only one that there is."""
        if repo is None:
            names = [r["repo"] for r in self.files.select("repo").distinct().limit(2).collect()]
            if len(names) > 1:
                raise ValueError("the corpus holds several trees; name one")
            repo = names[0] if names else ""
        own = Corpus(self.files.where(F.col("repo") == repo), self.modules)
        own.repo, own.cached = repo, self.cached
        if self.cached:
            own.parsed = self.parsed.where(F.col("repo") == repo)
        return own

    def module(self, path: str) -> Corpus:
        """The tree that a module path stands for, by the modules table; an unknown one is an error."""
        row = self.modules.where(F.col("module_path") == path).limit(1).collect()
        if not row:
            raise LookupError(f"module {path!r} is not among the known modules")
        own = Corpus.__new__(Corpus)
        own.spark, own.modules = self.spark, self.modules
        prefix = "" if row[0]["dir"] in ("", ".") else f"{row[0]['dir']}/"
        rows = self.files.where((F.col("repo") == row[0]["repo"]) & F.col("path").startswith(prefix))
        own.__init__(rows.select("repo", F.expr(f"substr(path, {len(prefix) + 1})").alias("path"), "content"), self.modules)
        own.header = f"# Module: {row[0]['module_path']} @ {row[0]['version']}\n# Location: {row[0]['dir']}"
        return own

    header: str = ""
    repo: str = ""
    cached: bool = False
    origin: tuple[dict[str, str], dict[str, str]] | None = None
    layers: object = None  # operators.layers.Layers of a corpus that is an overlay


__all__ = ["Corpus", "parse", "parsed_row"]
