"""Types as a type checker prints them: names qualified by their package, spacing and parentheses settled."""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping

from canopy.functions.goscan import Field, ScanError, Scanner


class _Printer(Scanner):
    def __init__(self, source: str, package: str, local: Collection[str], imported: Mapping[str, str]):
        super().__init__(source.encode())
        self.package, self.local, self.imported = package, local, imported

    def _inner(self, source: str) -> str:
        return type_string(source, self.package, self.local, self.imported)

    def _tuple(self, fields: list[Field]) -> str:
        return "(" + ", ".join((f"{n} " if n else "") + ("..." if f.variadic else "") + self._inner(f.type_src) for f in fields for n in f.names or [""]) + ")"

    def _signature(self) -> str:
        params, _ = self._parameters()
        results, _ = self._results()
        return self._tuple(params) + _spaced(results_string([(n, self._inner(f.type_src)) for f in results for n in f.names or [""]]))

    def _bracketed(self) -> str:
        """What is between brackets, as the source has it."""
        start = self.token.end
        end = self.skip_balanced().start
        return self.text(start, end).strip()

    def printed(self) -> str:
        if self.token.kind == "name":
            name = self.next().text
            if self.is_sign("."):
                self.next()
                name = f"{self.imported.get(name, name)}.{self.expect_name().text}"
            elif name in self.local:
                name = f"{self.package}.{name}"
            if self.is_sign("["):
                self.next()
                inner = [self.printed()]
                while self.is_sign(","):
                    self.next()
                    inner.append(self.printed())
                self.expect("]")
                name += f"[{','.join(inner)}]"
            return name
        if self.is_sign("*", "~"):
            return self.next().text + self.printed()
        if self.is_sign("("):
            self.next()
            inner = self.printed()
            self.expect(")")
            return inner
        if self.is_sign("["):
            return f"[{self._bracketed()}]" + self.printed()
        if self.is_keyword("map"):
            self.next()
            key = self._bracketed()
            return f"map[{self._inner(key)}]" + self.printed()
        if self.is_sign("<-"):
            self.next()
            self.next()
            return "<-chan " + self.printed()
        if self.is_keyword("chan"):
            self.next()
            if self.is_sign("<-"):
                self.next()
                return "chan<- " + self.printed()
            inner = self.printed()
            return f"chan ({inner})" if inner.startswith("<-") else "chan " + inner
        if self.is_keyword("func"):
            self.next()
            return "func" + self._signature()
        if self.is_keyword("struct"):
            self.next()
            fields = [" ".join([*([n] if n else []), self._inner(f.type_src), *([json.dumps(_tag(f.tag_src), ensure_ascii=False)] if f.tag_src else [])]) for f in self._struct() for n in f.names or [""]]
            return "struct{" + "; ".join(fields) + "}"
        if self.is_keyword("interface"):
            self.next()
            return "interface{" + "; ".join(self._member()) + "}"
        raise self.fail(f"expected type, found {self.token.text!r}")

    def _member(self) -> list[str]:
        self.expect("{")
        out = []
        while not self.is_sign("}"):
            if self.token.kind == "name" and self.peek().text == "(":
                name = self.next().text
                out.append(name + self._signature())
            else:
                union = [self.printed()]
                while self.is_sign("|"):
                    self.next()
                    union.append(self.printed())
                out.append(" | ".join(union))
            self.end_statement()
        self.next()
        return out


def _tag(source: str) -> str:
    return source[1:-1] if source.startswith("`") else json.loads(source)


def _spaced(text: str) -> str:
    return f" {text}" if text else ""


def type_string(source: str, package: str, local: Collection[str], imported: Mapping[str, str]) -> str:
    """A type's source text with the package's own names qualified, and imported ones by the name of their
    package instead of a local alias; text that is no type stays as it is."""
    try:
        printer = _Printer(source, package, local, imported)
        text = printer.printed()
        return text if printer.is_sign(";") or printer.token.kind == "end" else source
    except ScanError:
        return source


def results_string(results: list[tuple[str, str]]) -> str:
    """Results (name, type) as a signature ends: nothing, one type by itself, or a list in parentheses."""
    if len(results) == 1 and not results[0][0]:
        return results[0][1]
    return "(" + ", ".join(f"{n} {t}" if n else t for n, t in results) + ")" if results else ""
