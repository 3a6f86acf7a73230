"""Looking symbols up by name, receiver and package."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import columns as c
from canopy.plans.corpus import Corpus


@dataclass(frozen=True)
class SymbolQuery:
    name: str
    receiver: str = ""
    package: str = ""
    tests: bool = False
    module: str = ""


RESULT = ("repo", "file", "line_start", "line_end", "name", "receiver", "signature", "doc", "code")


def _walked(rows: DataFrame, tests: bool, folder: str) -> DataFrame:
    """Rows of files that a walk from a directory visits: no `vendor`, no directories that start with a dot."""
    if not tests:
        rows = rows.where("not is_test")
    root = folder.rsplit("/", 1)[-1]
    if root == "vendor" or (root.startswith(".") and folder != "."):
        return rows.where(F.lit(False))
    if folder != ".":
        rows = rows.where((F.col("dir") == folder) | F.startswith(F.col("dir"), F.lit(folder + "/")))
    inner = F.when(F.col("dir") == ".", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    return rows.where(~F.exists(inner, lambda p: (p == "vendor") | F.startswith(p, F.lit("."))))


def results(decls: DataFrame) -> DataFrame:
    """Symbol rows of declarations, in walk order (component by component) by `walk` and `ord`."""
    d = F.col("d")
    text = c.byte_slice(F.col("content"), d["sym_start"], d["sym_end"])
    is_func = d["kind"] == "func"
    type_text = c.trimmed(c.byte_slice(F.col("content"), d["name_start"], d["sym_end"]))
    doc = F.when(is_func, d["doc"]).when(d["spec_doc"] != "", d["spec_doc"]).when(d["group_size"] == 1, d["doc"]).otherwise(F.lit(""))
    return decls.select(
        "repo",
        F.col("path").alias("file"),
        d["line_start"].alias("line_start"),
        d["line_end"].alias("line_end"),
        d["name"].alias("name"),
        d["receiver"].alias("receiver"),
        F.when(is_func, c.func_signature(F.col("content"), d)).otherwise(type_text).alias("signature"),
        c.trimmed(doc).alias("doc"),
        c.numbered_code(text, d["line_start"]).alias("code"),
        F.split("path", "/").alias("walk"),
        d["ord"].alias("ord"),
    )


def find_symbols(corpus: Corpus, query: SymbolQuery, folder: str = ".") -> DataFrame:
    """Functions whose name (and receiver, if asked for) matches; types by name, unless a receiver is given."""
    return _found(corpus, query, folder).orderBy("repo", "walk", "ord").select(*RESULT)


def _found(corpus: Corpus, query: SymbolQuery, folder: str) -> DataFrame:
    if query.module:
        corpus = corpus.module(query.module)
    d = F.col("d")
    wanted: Column = (d["kind"] == "func") & (F.lit(not query.receiver) | (d["receiver"] == query.receiver))
    if not query.receiver:
        wanted = wanted | (d["kind"] == "type")
    # the name filter runs before the declarations are exploded, so that few rows carry their file's bytes
    files = _walked(corpus.parsed, query.tests, folder).where("parse_ok")
    if query.package:
        files = files.where(F.col("package") == query.package)
    rows = files.select("repo", "path", "content", F.explode(F.filter("decls", lambda x: x["name"] == query.name)).alias("d"))
    return results(rows.where(wanted))


def queries_of(text: str, tests: bool = False, module: str = "") -> list[SymbolQuery]:
    """A dotted name: name; receiver.name and package.name; package.receiver.name; more parts match nothing."""
    parts = text.split(".")
    if len(parts) == 1:
        return [SymbolQuery(parts[0], tests=tests, module=module)]
    if len(parts) == 2:
        return [SymbolQuery(parts[1], receiver=parts[0], tests=tests, module=module), SymbolQuery(parts[1], package=parts[0], tests=tests, module=module)]
    if len(parts) == 3:
        return [SymbolQuery(parts[2], receiver=parts[1], package=parts[0], tests=tests, module=module)]
    return []


def resolve(corpus: Corpus, text: str, tests: bool = False, folder: str = ".", module: str = "") -> DataFrame:
    """All readings of a dotted name, one after the other, duplicates kept."""
    found = [_found(corpus, q, folder).withColumn("reading", F.lit(i)) for i, q in enumerate(queries_of(text, tests, module))]
    if not found:
        return results(corpus.decls.where(F.lit(False))).select(*RESULT)
    return reduce(DataFrame.unionByName, found).orderBy("repo", "reading", "walk", "ord").select(*RESULT)


def bucketed(found: DataFrame) -> DataFrame:
    """Add bucket: methods, functions or structs."""
    return found.withColumn("bucket", F.when(F.col("receiver") != "", "methods").when(F.col("signature").startswith("func"), "functions").otherwise("structs"))


def file_report(corpus: Corpus, path: str) -> DataFrame:
    """Exported functions and types of one file, with their lines; receivers as written."""
    rows = corpus.parsed.where((F.col("path") == path) & F.col("parse_ok")).select("repo", "path", "content", F.explode("decls").alias("d")).where("d.exported")
    d = F.col("d")
    text = F.when(d["kind"] == "func", c.func_signature(F.col("content"), d)).otherwise(c.trimmed(c.byte_slice(F.col("content"), d["name_start"], d["sym_end"])))
    return rows.select(
        "repo", F.col("path").alias("file"), d["ord"].alias("ord"), d["line_start"].alias("line_start"), d["line_end"].alias("line_end"), d["name"].alias("name"), d["receiver_src"].alias("receiver"), text.alias("signature")
    ).orderBy("repo", "ord")
