"""Interfaces as tables of methods: closure over embedded ones, stubs for what a type lacks, typed mocks.

Interfaces come from a tree itself and from a catalog table (schemas.CATALOG) that stands for packages outside
it. An interface is known by its tree, its package's home (the import path, or the directory in a tree without a
module file) and its name, so trees and packages that share names stay apart. Rows that reach the driver are
one interface's methods.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from canopy.functions import columns as c
from canopy.functions import gotext as g
from canopy.functions.gotypes import type_string
from canopy.operators.edits import overlay
from canopy.operators.ordered import joined
from canopy.operators.symbols import RESULT, results
from canopy.plans import schemas
from canopy.plans.corpus import Corpus
from canopy.plans.lineage import checkpointed

_METHODS = T.StructType([T.StructField("home", T.StringType()), *schemas.CATALOG.fields])


def package_homes(corpus: Corpus) -> DataFrame:
    """repo, dir, home: the import path of each directory, by the nearest module file at or above it."""
    dirs = corpus.go_files.select("repo", "dir").distinct()
    parts = F.when(F.col("dir") == ".", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.when(n == 0, ".").otherwise(F.array_join(F.slice("parts", 1, n), "/")))
    modules = corpus.module_paths.select("repo", F.col("dir").alias("at"), "module")
    found = dirs.withColumn("parts", parts).select("repo", "dir", F.posexplode(above).alias("depth", "at")).join(modules, ["repo", "at"])
    nearest = found.groupBy("repo", "dir").agg(F.max_by(F.struct("module", "at"), "depth").alias("m"))
    inner = F.when(F.col("m.at") == ".", F.col("dir")).when(F.col("m.at") == F.col("dir"), ".").otherwise(F.expr("substr(dir, length(m.at) + 2)"))
    home = F.when(F.col("m").isNull(), F.col("dir")).when(inner == ".", F.col("m.module")).otherwise(F.concat("m.module", F.lit("/"), inner))
    return dirs.join(nearest, ["repo", "dir"], "left").select("repo", "dir", home.alias("home"))


def _members(corpus: Corpus) -> DataFrame:
    """corpus.iface_members with home, and imported: package paths by the names that the file knows them by."""
    name = F.when(F.col("alias") != "", F.col("alias")).otherwise(F.substring_index("import_path", "/", -1))
    named = corpus.imports.select("repo", "path", name.alias("k"), "import_path").dropDuplicates(["repo", "path", "k"])
    maps = named.groupBy("repo", "path").agg(F.map_from_entries(F.collect_list(F.struct("k", "import_path"))).alias("imported"))
    return corpus.iface_members.join(package_homes(corpus), ["repo", "dir"]).join(maps, ["repo", "path"], "left")


def declared_methods(corpus: Corpus) -> DataFrame:
    """home and schemas.CATALOG of one tree: what each interface itself declares, types as a type checker prints them."""
    local = corpus.decls.where("d.kind = 'type'").groupBy("repo", "dir", "package").agg(F.collect_set("d.name").alias("local"))
    rows = _members(corpus).where("method is not null").join(local, ["repo", "dir", "package"])
    rows = rows.select("home", "package", "iface", "ord", "method", "params", "results", "local", F.map_entries("imported").alias("imported"))
    schema = to_arrow_schema(_METHODS)

    def flat(fields: list[dict], package: str, own: set[str], imported: dict[str, str]) -> list[dict]:
        return [{"name": n, "type": type_string(f["type_src"], package, own, imported), "variadic": f["variadic"]} for f in fields for n in (f["names"] or [""])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                names = r["package"], set(r["local"]), {e["key"]: e["value"].rsplit("/", 1)[-1] for e in r["imported"] or []}
                out.append({k: r[k] for k in ("home", "package", "iface", "ord", "method")} | {"params": flat(r["params"], *names), "results": flat(r["results"], *names)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, _METHODS)


def embeddings(corpus: Corpus) -> DataFrame:
    """home, iface, to_home, to_iface of every embedded interface of one tree."""
    parts = F.split("type_src", r"\.")
    rows = _members(corpus).where(r"method is null and type_src rlike '^[\\w.]+$'")
    target = F.when(F.size(parts) > 1, F.coalesce(F.element_at("imported", parts[0]), parts[0])).otherwise(F.col("home"))
    return rows.select("home", "iface", target.alias("to_home"), F.element_at(parts, -1).alias("to_iface")).distinct()


def method_sets(corpus: Corpus, catalog: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """home and schemas.CATALOG of one tree and the catalog, with the methods of embedded interfaces, sorted by name
    (ord from 0); of all interfaces, or of those of one name, from which alone embedding is then followed. An interface
    among them that embeds itself, however far, is an error."""
    own, edges = checkpointed(declared_methods(corpus)), checkpointed(embeddings(corpus))
    known = own
    if catalog is not None:
        homes = package_homes(corpus).select("home").distinct()
        known = own.unionByName(catalog.withColumn("home", F.col("package")).withColumn("package", F.substring_index("package", "/", -1)).join(homes, "home", "left_anti"))
    # packages are compared by path, or by name where only that is known
    short = F.substring_index("at_home", "/", -1)
    first = known.select("home", "iface").unionByName(edges.select("home", "iface")).distinct()
    if only is not None:
        first = first.where(F.col("iface") == only)
    new = reach = checkpointed(first.withColumns({"at_home": F.col("home"), "at_iface": F.col("iface")}))
    step = edges.withColumnsRenamed({"home": "at_home", "iface": "at_iface"})
    while not new.isEmpty():  # as often as interfaces are nested
        new = new.join(step, ["at_home", "at_iface"]).select("home", "iface", F.col("to_home").alias("at_home"), F.col("to_iface").alias("at_iface")).distinct()
        if circle := new.where("home = at_home and iface = at_iface").orderBy("home", "iface").first():
            raise g.EngineError("INVALID_ACTION", f"interface {circle['home']}.{circle['iface']} embeds itself")
        new = checkpointed(new.join(reach, ["home", "iface", "at_home", "at_iface"], "left_anti"))
        reach = reach.unionByName(new)
    places = known.select("home", "iface").distinct()
    exact = reach.join(places.withColumnsRenamed({"home": "at_home", "iface": "at_iface"}), ["at_home", "at_iface"], "left_semi")
    loose = reach.join(exact, ["home", "iface", "at_home", "at_iface"], "left_anti").withColumn("at_home", short)
    methods = known.select(F.col("home").alias("at_home"), F.col("iface").alias("at_iface"), "method", "params", "results")
    found = exact.unionByName(loose).join(methods, ["at_home", "at_iface"])
    one = F.min_by(F.struct("method", "params", "results"), F.struct("at_home", "at_iface"))  # the same method may come by several ways
    named = found.groupBy("home", "iface", "method").agg(one.alias("m")).groupBy("home", "iface").agg(F.array_sort(F.collect_list("m")).alias("m"))
    packages = known.select("home", "package").unionByName(corpus.pkg_clause.where("header_ok and not is_test").join(package_homes(corpus), ["repo", "dir"]).select("home", "package"))
    named = named.join(packages.groupBy("home").agg(F.min("package").alias("package")), "home")
    return named.select("home", "package", "iface", F.posexplode("m").alias("ord", "x")).select("home", "package", "iface", "ord", "x.method", "x.params", "x.results")


def resolve(corpus: Corpus, catalog: DataFrame | None, name: str, repo: str | None = None) -> tuple[str, str, list[g.Method]]:
    """(package name, interface, methods by name) of `package.Interface` as one tree knows it, the package by path, or
    by name where one package only has it."""
    corpus = corpus.only(repo)
    path, _, iface = name.rpartition(".")
    if not path:
        raise g.EngineError("NOT_FOUND", f"interface {name!r} must be given as package.Interface")
    rows = method_sets(corpus, catalog, iface).where((F.col("iface") == iface) & ((F.col("home") == path) | (F.col("package") == path))).orderBy("home", "ord").collect()
    rows = [r for r in rows if r["home"] == path] or rows
    if len(homes := sorted({r["home"] for r in rows})) > 1:
        raise g.EngineError("INVALID_ACTION", f"interface {name} is declared in several packages: {', '.join(homes)}")
    package = rows[0]["package"] if rows else path.rsplit("/", 1)[-1]
    if not rows:
        declared = corpus.decls.join(package_homes(corpus), ["repo", "dir"]).where((F.col("d.name") == iface) & ((F.col("home") == path) | (F.col("package") == path)))
        kinds = {r["p"]: r["k"] for r in declared.select(F.col("package").alias("p"), F.col("d.type_kind").alias("k")).distinct().collect()}
        if kinds and "interface" not in kinds.values():
            raise g.EngineError("NOT_FOUND", f"{name} is not an interface")
        if not kinds:
            raise g.EngineError("NOT_FOUND", f"interface {name} not found")
        package = min(kinds)
    of = lambda fields: tuple(g.Param(p["name"] or "", p["type"], bool(p["variadic"])) for p in fields)
    return package, iface, [g.Method(r["method"], of(r["params"]), of(r["results"])) for r in rows]


def package_name(corpus: Corpus, path: str) -> str:
    """Package of a path's directory in one tree, by its first production file; else the directory's name."""
    home = os.path.dirname(path) or "."
    rows = corpus.pkg_clause.where((F.col("dir") == home) & ~F.col("is_test") & F.col("header_ok"))
    found = rows.agg(F.min_by("package", "name").alias("p")).first()["p"]
    return found or os.path.basename(home)


def _required(*values: str) -> None:
    if not all(values):
        raise g.EngineError("INVALID_ACTION", "interface, receiver, and file path are required")


def mock(corpus: Corpus, interface: str, receiver: str, path: str, catalog: DataFrame | None = None, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mock's file in one tree (the only one, if none is named), and a row that says what was generated."""
    _required(interface, receiver, path)
    corpus = corpus.only(repo)
    package, iface, methods = resolve(corpus, catalog, interface, corpus.repo)
    text = g.mock_source(package_name(corpus, path), receiver, methods, package, iface, typed=True)
    message = f"Generated {g.base_name(receiver)} with {len(methods)} methods in {path}"
    spark = corpus.spark
    return spark.createDataFrame([(corpus.repo, path, bytearray(text.encode()))], schemas.EDITED), spark.createDataFrame([(corpus.repo, message)], "repo string, message string")


def _own_methods(corpus: Corpus, receiver: str, path: str) -> DataFrame:
    """method, params, results (how many) of a type's methods in a path's directory, test files included."""
    d, home = F.col("d"), os.path.dirname(path) or "."
    have = corpus.decls.where((F.col("dir") == home) & (d["kind"] == "func") & (d["receiver_src"] != "") & (d["receiver"] == g.base_name(receiver)))
    return have.select(d["name"].alias("method"), c.field_count(d["params"]).alias("params"), c.field_count(d["results"]).alias("results"))


def conflicts(need: DataFrame, have: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Of methods needed (keys, want_params, want_results) those that are there (keys, params, results) with other
    numbers. Keys name a method: by itself, or with its tree, type and whatever else; nulls are values like others."""
    return joined(need, have, keys).where("params <> want_params or results <> want_results")


def lacking(need: DataFrame, have: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Rows of methods needed that are not there, by keys."""
    return joined(need, have.select(*keys).distinct(), keys, "left_anti")


def missing_methods(corpus: Corpus, interface: str, receiver: str, path: str, catalog: DataFrame | None = None, repo: str | None = None) -> list[g.Method]:
    """Methods of an interface that a type lacks in its directory (test files count); one that is there
    with another number of parameters or results is a conflict."""
    corpus = corpus.only(repo)
    _, _, methods = resolve(corpus, catalog, interface, corpus.repo)
    if not methods:
        return []
    need = corpus.spark.createDataFrame([(m.name, len(m.params), len(m.results)) for m in methods], "method string, want_params int, want_results int")
    have = _own_methods(corpus, receiver, path)
    if conflict := conflicts(need, have).orderBy("method").first():
        raise g.EngineError(
            "CONFLICT",
            f"conflict: method '{conflict['method']}' already exists on {g.base_name(receiver)} but signature mismatches! Expected {conflict['want_params']} params and "
            f"{conflict['want_results']} results, got {conflict['params']} params and {conflict['results']} results",
        )
    absent = {r["method"] for r in lacking(need, have).select("method").collect()}
    return [m for m in methods if m.name in absent]


def implement(corpus: Corpus, interface: str, receiver: str, path: str, catalog: DataFrame | None = None, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The file of one tree (the only one, if none is named) with stubs of the missing methods, and their symbols;
    nothing missing gives no rows."""
    _required(interface, receiver, path)
    corpus = corpus.only(repo)
    target = corpus.files.where(F.col("path") == path).select("repo", "path", "content")
    if target.isEmpty():
        raise g.EngineError("READ_ERROR", f"failed to read file {path}")
    missing = missing_methods(corpus, interface, receiver, path, catalog, corpus.repo)
    text = "".join(g.stub(interface, receiver, m) for m in missing)
    changed = target.where(F.lit(bool(missing))).select("repo", "path", F.concat("content", F.lit(text.encode())).alias("content"))
    after = overlay(Corpus.of_files(target), changed)
    names = [m.name for m in missing]
    rows = after.decls.where((F.col("d.kind") == "func") & (F.col("d.receiver_src") != "") & F.col("d.name").isin(names))
    symbols = results(rows).withColumn("receiver", F.lit(g.base_name(receiver))).orderBy("repo", "walk", "ord").select(*RESULT)
    return changed, symbols


def unresolved_selectors(corpus: Corpus, path: str) -> DataFrame:
    """Roots of `name.Name` expressions in a file that are neither imported, nor the package, nor declared
    in it: candidates for a missing import. Local variables are told apart by their names being assigned."""
    rows = corpus.parsed.where(F.col("path") == path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r'(?s)//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:[^"\\\n]|\\.)*"', '""')
    roots = rows.select("repo", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w.)\]])([A-Za-z_]\w*)\.[A-Z]\w*"), F.lit(1)))).alias("name"))
    imported = rows.select("repo", F.explode("imports").alias("i")).select("repo", F.when(F.col("i.alias") != "", F.col("i.alias")).otherwise(F.substring_index("i.import_path", "/", -1)).alias("name"))
    package = rows.select("repo", F.col("package").alias("name"))
    declared = rows.select("repo", F.explode("decls").alias("d"))
    names = declared.select("repo", F.col("d.name").alias("name")).unionByName(declared.select("repo", F.col("d.receiver_var").alias("name")))
    params = declared.select("repo", F.explode(F.concat("d.params", "d.results")).alias("p")).select("repo", F.explode("p.names").alias("name"))
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)(?:\s*,\s*[A-Za-z_]\w*)*\s*:=|\b(?:var|const)\s+([A-Za-z_]\w*)"), F.lit(1))
    locals_ = rows.select("repo", F.explode(words).alias("name"))
    known = imported.unionByName(package).unionByName(names).unionByName(params).unionByName(locals_)
    return roots.join(known, ["repo", "name"], "left_anti").orderBy("repo", "name")
