"""The scalar rules as Spark column expressions; everything runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, of any kind.
_ENDS = r"(?U)^\s+|\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Text of content[start:end], in bytes."""
    return F.decode(F.substring(content, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def func_signature(content: Column, d: Column) -> Column:
    """From the declaration to its body, or all of it if it has none."""
    return trimmed(byte_slice(content, d["node_start"], F.coalesce(d["body_start"], d["node_end"])))


def struct_signature(d: Column, inline: int = 5) -> Column:
    """Up to `inline` parts on one line, else one part a line with four spaces."""
    parts = F.flatten(
        F.transform(
            d["fields"],
            lambda f: F.when(F.size(f["names"]) == 0, F.array(f["type_src"])).otherwise(F.transform(f["names"], lambda n: F.concat(n, F.lit(" "), f["type_src"]))),
        )
    )
    head = F.concat(F.lit("type "), d["name"], F.lit(" struct {"))
    return (
        F.when(F.size(parts) == 0, F.concat(head, F.lit("}")))
        .when(F.size(parts) <= inline, F.concat(head, F.lit(" "), F.array_join(parts, "; "), F.lit(" }")))
        .otherwise(F.concat(head, F.lit("\n"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("    "), p)), "\n"), F.lit("\n}")))
    )


def interface_signature(d: Column) -> Column:
    parts = F.transform(d["members"], lambda m: F.coalesce(m["method"], m["type_src"]))
    head = F.concat(F.lit("type "), d["name"], F.lit(" interface {"))
    return F.when(F.size(parts) == 0, F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(" "), F.array_join(parts, "; "), F.lit(" }")))


def graph_signature(content: Column, d: Column) -> Column:
    return (
        F.when(d["kind"] == "func", func_signature(content, d))
        .when(d["type_kind"] == "struct", struct_signature(d))
        .when(d["type_kind"] == "interface", interface_signature(d))
        .otherwise(F.concat(F.lit("type "), d["name"], F.lit(" "), d["type_src"]))
    )


def numbered_code(text: Column, first_line: Column) -> Column:
    """The lines that are not blank, each with its number."""
    rows = F.transform(F.split(text, "\n"), lambda line, i: F.struct((first_line + i).cast("string").alias("n"), line.alias("line")))
    rows = F.filter(rows, lambda r: r["line"].rlike(r"(?U)\S"))
    return F.array_join(F.transform(rows, lambda r: F.concat(r["n"], F.lit(": "), r["line"])), "\n")


def package_summary(doc: Column) -> Column:
    """First line of a package's documentation without `Package <name>`; empty if that is all."""
    line = trimmed(F.substring_index(trimmed(doc), "\n", 1))
    rest = F.substring(line, 9, 1 << 30)
    stripped = F.when(F.instr(rest, " ") > 0, trimmed(F.regexp_replace(rest, "^[^ ]* ", ""))).otherwise(F.lit(""))
    return F.when(F.lower(line).startswith("package "), stripped).otherwise(line)


def dependency(import_path: Column, module: Column) -> Column:
    """The import relative to the module; null for imports from elsewhere and for the module's root."""
    prefix = F.concat(module, F.lit("/"))
    return F.when(F.startswith(import_path, prefix), F.substr(import_path, F.length(prefix) + 1))


def package_bytes(with_summary: bool = True, with_deps: bool = True, with_symbols: bool = True, with_files: bool = True) -> Column:
    """Bytes of a package row at a level of detail: 4 of them count as a token; a dependency costs 2 more."""
    total = F.octet_length("path")
    if with_summary:
        total = total + F.octet_length("summary")
    if with_deps:
        total = total + F.coalesce(F.aggregate("deps", F.lit(0), lambda s, d: s + F.octet_length(d) + 2), F.lit(0))
    if with_files:
        total = total + F.coalesce(F.aggregate("files", F.lit(0), lambda s, f: s + F.octet_length(f["path"])), F.lit(0))
        if with_symbols:
            total = total + F.coalesce(
                F.aggregate("files", F.lit(0), lambda s, f: s + F.coalesce(F.aggregate(f["symbols"], F.lit(0), lambda t, x: t + F.octet_length(x)), F.lit(0))), F.lit(0)
            )
    return total.cast("long")


def camel_name(name: Column) -> Column:
    return F.when(name == "ID", F.lit("id")).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))


def snake_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def doc_comment(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(line == "", F.lit("//")).otherwise(F.concat(F.lit("// "), line)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", "")


def field_count(fields: Column) -> Column:
    """Names in a list of fields, an unnamed field counting as one."""
    return F.aggregate(fields, F.lit(0), lambda n, f: n + F.greatest(F.size(f["names"]), F.lit(1)))


def without_spans(content: Column, spans: Column) -> Column:
    """Binary content without byte ranges (start, end), the last one cut first."""
    ordered = F.reverse(F.array_sort(spans))
    return F.aggregate(
        ordered,
        content,
        lambda c, s: F.concat(F.substring(c, F.lit(1), s["start"]), F.substring(c, s["end"] + 1, F.lit(1 << 30))),
    )
