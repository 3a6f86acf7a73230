"""Text of query results, for people. The rows of one answer come to the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from canopy.operators.graph import GraphOptions
from canopy.operators.symbols import bucketed


def _head(row, deps: bool) -> str:
    line = row["path"] + (f" — {row['summary']}" if row["summary"] else "")
    if row["deps"]:
        return f"{line} → {', '.join(row['deps'])}"
    return f"{line} → (none)" if deps else line


def _blocks(row) -> list[str]:
    return [line for f in row["files"] or [] for line in (f["path"], *(f"  {part}" for s in f["symbols"] or [] for part in s.split("\n")))]


def graph_text(packages: DataFrame, o: GraphOptions, children: list[str] | None = None, style: str = "terminal") -> str:
    """The map as text. The styles differ under a focus: `terminal` heads packages only if summary or deps
    were asked for outright, and lists other paths without blank lines between; `tool` heads them always.
    Children are the sub-packages that a look at one directory leaves out."""
    rows, shown = packages.orderBy("repo", "ord").collect(), o.implied()
    empty = f"No Go packages found in '{o.dir}'."
    if not shown.symbols:
        hint = "\nHint: check that you're in the project root, or use '--dir <path>' to target a subdirectory.\n" if style == "terminal" else ""
        return "".join(_head(r, o.deps) + "\n" for r in rows) if rows else empty + hint
    heads = (o.summary or o.deps) if style == "terminal" else (shown.summary or shown.deps)
    out: list[str] = []
    for row in rows:
        headed = heads and bool(row["summary"] or row["deps"])
        if not headed and not row["files"]:
            if o.focus:
                out += [""] * bool(out and style == "tool") + [row["path"]]
            continue
        out += [""] * bool(out) + ([_head(row, o.deps) if o.deps else _head({**row.asDict(), "deps": None}, False)] if heads else []) + _blocks(row)
    if style == "terminal" and not shown.recursive and not o.focus:
        if children:
            out += ["", f"Sub-packages (use -r to include): {', '.join(children)}"]
        elif not out:
            out = [f"No Go files found in '{o.dir}'.", "Hint: use '--dir <path>' to target a package directory, or '-r' to walk sub-packages."]
    if style == "tool" and not out:
        return empty
    return "".join(line + "\n" for line in out)


def symbol_text(found: DataFrame, query: str, body: bool = False) -> str:
    """One symbol in full, or the list of those that match."""
    rows = bucketed(found).collect()
    if not rows:
        return f"No symbols found matching '{query}'.\n"
    if len(rows) == 1:
        r = rows[0]
        out = [f"Symbol: {r['name']}"] + [f"Receiver: {r['receiver']}"] * bool(r["receiver"])
        out.append(f"File: {r['file']}:{r['line_start']}-{r['line_end']} ({r['line_end'] - r['line_start'] + 1} lines body)")
        out += [f"Doc:\n{r['doc']}"] * bool(r["doc"])
        out.append(f"Code (Empty lines stripped):\n{r['code']}" if body else f"Signature:\n{r['signature']}")
        return "\n".join(out) + "\n"
    out = [f"Found {len(rows)} matches for '{query}'. Please refine your search:", ""]
    groups = {name: [r for r in rows if r["bucket"] == name] for name in ("methods", "functions", "structs")}
    for name, members in groups.items():
        if members:
            out.append(f"Matches ({name.capitalize()}):")
            out += [f"- {'(' + r['receiver'] + ') ' if name == 'methods' else ''}{r['name']} in {r['file']}:{r['line_start']}" for r in members]
            out.append("")
    first = next(members[0] for members in groups.values() if members)
    owner = f"{first['receiver']}." if first["receiver"] else ""
    where = "" if owner else f" dir={os.path.dirname(first['file']) or '.'}"
    return "\n".join([*out, f"Hint: refine with 'symbol query={owner}{first['name']}{where}'."]) + "\n"


def report_text(report: DataFrame) -> str:
    """The exported symbols of a file after it was written."""
    rows = report.collect()
    return "".join(f"  {r['signature'].split(chr(10))[0]} (lines {r['line_start']}-{r['line_end']})\n" for r in rows)


def outcome_text(outcomes: DataFrame) -> str:
    """Success and warning lines of a plan, or its failure with a hint."""
    from canopy.functions.gotext import HINTS

    out = []
    for r in outcomes.orderBy("repo").collect():
        out += [f"WARNING: {w}" for w in r["warnings"]]
        if r["error_code"]:
            out.append(f"[{r['error_code']}] {r['error_message']}")
            out += [f"Hint: {HINTS[r['error_code']]}"] * (r["error_code"] in HINTS)
        else:
            out.append(f"SUCCESS: {r['files_modified']} file(s) modified")
    return "".join(line + "\n" for line in out)
