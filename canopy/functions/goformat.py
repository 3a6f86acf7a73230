"""Layout of Go source as its formatter has it, as far as a scanner can tell.

Settled are: blanks at the ends of lines and before an opening brace, runs of blank lines, the end of the file, the columns
of struct fields, and the order and grouping of imports. What a comment or a raw string touches stays as it is, and
so does source that does not scan. Imports are neither added nor removed.
"""

from __future__ import annotations

import re

from canopy.functions.goscan import Decl, ScanError, Scanner, scan

_SPEC = re.compile(r'^\s*(?:([\w.]+)\s+)?("(?:[^"\\]|\\.)+")\s*;?\s*$')


def formatted(source: bytes) -> bytes:
    for step in (_imports, _structs, _lines):
        try:
            parsed = scan(source)
            if parsed.error:
                return source
            source = step(source, Scanner(source), parsed.decls)
        except ScanError:
            return source
    return source


def _spliced(source: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    for start, end, text in sorted(edits, reverse=True):
        source = source[:start] + text.encode() + source[end:]
    return source


def _comments(scanner: Scanner) -> list[tuple[int, int]]:
    return [(c.start, c.end) for t in scanner.tokens for c in t.lead or []]


def _imports(source: bytes, scanner: Scanner, decls: list[Decl]) -> bytes:
    """Sections of an import block sorted by path, the standard library's before others and apart from them."""
    edits, tokens = [], scanner.tokens
    for i, t in enumerate(tokens):
        if t.kind == "keyword" and t.text == "import" and tokens[i + 1].text == "(":
            close = next(k for k in range(i + 2, len(tokens)) if tokens[k].text == ")")
            start, end = tokens[i + 1].end, tokens[close].start
            if b"//" in source[start:end].replace(b'"', b" ") and any(start <= a < end for a, _ in _comments(scanner)) or b"/*" in source[start:end]:
                continue
            sections = [[_SPEC.match(line) for line in part.split("\n") if line.strip()] for part in re.split(r"\n\s*\n", source[start:end].decode())]
            if not all(m for section in sections for m in section):
                continue
            groups = []
            for section in sections:
                specs = sorted({(("." in m[2].split("/")[0]), m[2], m[1] or "") for m in section})
                groups += [[s for s in specs if s[0] == other] for other in (False, True)]
            shown = "\n\n".join("\n".join(f"\t{alias} {path}" if alias else f"\t{path}" for _, path, alias in g) for g in groups if g)
            edits.append((start, end, f"\n{shown}\n" if shown else ""))
        if t.kind == "keyword" and t.text in ("func", "type", "var", "const"):
            break
    return _spliced(source, edits)


def _structs(source: bytes, scanner: Scanner, decls: list[Decl]) -> bytes:
    """Types and tags of neighbouring fields in columns."""
    comments, edits = _comments(scanner), []
    for d in decls:
        section: list[tuple[int, int, str, str, str]] = []  # line start, line end, names, type, tag

        def settle(section: list[tuple[int, int, str, str, str]]) -> None:
            wide = max((len(s[2]) for s in section), default=0)
            for k, (start, end, names, kind, tag) in enumerate(section):
                line = f"\t{names.ljust(wide)} {kind}"
                if tag:  # a column reaches as far as lines next to each other have it
                    low = high = k
                    while low and section[low - 1][4]:
                        low -= 1
                    while high + 1 < len(section) and section[high + 1][4]:
                        high += 1
                    line += " " * (max(len(s[3]) for s in section[low : high + 1]) - len(kind)) + f" {tag}"
                edits.append((start, end, line))

        for f in d.fields if d.type_kind == "struct" and d.group_size == 1 else []:
            start = source.rfind(b"\n", 0, f.type_start) + 1
            end = source.find(b"\n", f.type_end)
            stop = f.tag_end or f.type_end
            plain = f.names and start > d.node_start and end >= 0 and stop <= end and not source[stop:end].strip() and "\n" not in f.type_src
            plain = plain and source[start : f.type_start].decode().split() == ", ".join(f.names).split() and not any(start <= a <= end for a, _ in comments)
            if not plain or (section and section[-1][1] + 1 != start):
                settle(section)
                section = []
            if plain:
                section.append((start, end, ", ".join(f.names), f.type_src, f.tag_src or ""))
        settle(section)
    return _spliced(source, edits)


def _lines(source: bytes, scanner: Scanner, decls: list[Decl]) -> bytes:
    kept = [*_comments(scanner), *((t.start, t.end) for t in scanner.tokens if t.kind == "string" and t.text.startswith("`"))]
    inside = lambda at: any(a <= at < b for a, b in kept)
    edits = []
    for before, t in zip(scanner.tokens, scanner.tokens[1:], strict=False):
        if t.text == "{" and t.kind == "sign" and source[before.end : t.start].strip(b" ") == b"" and t.start - before.end > 1:
            edits.append((before.end, t.start, " "))
    source = _spliced(source, edits)
    if edits:
        return _lines(source, Scanner(source), decls)
    out, blank = [], 0
    for m in re.finditer(rb"[^\n]*(?:\n|$)", source):
        line = m[0]
        if not line or inside(m.end() - 1) and source[m.end() - 1 : m.end()] == b"\n":
            out.append(line)
            blank = 0
            continue
        line = line.rstrip(b" \t\r\n")
        blank = 0 if line else blank + 1
        if line or (blank == 1 and out):
            out.append(line + b"\n")
    return b"".join(out).rstrip(b"\n") + b"\n" if out else source
