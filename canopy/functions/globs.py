"""Shell globs of one path component, as a pattern: * and ? do not cross a slash, [..] is a class, \\ quotes."""

from __future__ import annotations

import re


def glob_pattern(glob: str) -> str | None:
    """The whole-match pattern of a glob, in syntax that Python and Java share; None if it is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            i += 1
            negated = glob[i : i + 1] == "^"
            i += negated
            items: list[str] = []
            while True:
                if i >= len(glob):
                    return None
                if glob[i] == "]" and items:
                    break
                ends = []
                for _ in range(2):
                    if i >= len(glob) or glob[i] in "-]":
                        return None
                    if glob[i] == "\\":
                        i += 1
                        if i >= len(glob):
                            return None
                    ends.append(glob[i])
                    i += 1
                    if len(ends) == 2 or glob[i : i + 1] != "-":
                        break
                    i += 1
                if len(ends) == 2 and ends[0] > ends[1]:
                    return None
                items.append("-".join(re.sub(r"([\\\]\[^&-])", r"\\\1", e) for e in ends))
            out.append(f"[{'^' if negated else ''}{''.join(items)}]")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_match(glob: str, name: str) -> bool:
    """Whether a glob matches a whole name; a malformed one matches nothing."""
    pattern = glob_pattern(glob)
    return pattern is not None and re.fullmatch(pattern, name) is not None
