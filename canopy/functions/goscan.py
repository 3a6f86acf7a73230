"""A declaration scanner for Go source, over bytes.

It finds what the tables need: package clause, imports, functions and types with their documentation and
byte offsets, struct fields, interface members, parameters and results. Bodies and constant or variable
declarations are skipped by balanced brackets, so it accepts some files that a full parser would reject;
what it cannot place makes `error` say where. The header (package, imports) survives a broken body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The language's keywords, and the token kinds after which a line end is a semicolon.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_ENDING_KEYWORDS = frozenset(("break", "continue", "fallthrough", "return"))
_ENDING_SIGNS = frozenset(("++", "--", ")", "]", "}"))

_TOKEN = re.compile(
    rb"(?P<blank>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<raw>`[^`]*`)"
    rb'|(?P<string>"(?:[^"\\\n]|\\[^\n])*")|(?P<rune>\'(?:[^\'\\\n]|\\[^\n])+\')'
    rb"|(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)|(?P<number>[0-9](?:[0-9A-Za-z_.]|(?<=[eEpP])[+-])*|\.[0-9](?:[0-9A-Za-z_]|(?<=[eEpP])[+-])*)"
    rb"|(?P<sign>\.\.\.|<-|\+\+|--|&\^=?|<<=?|>>=?|[-+*/%&|^=!<>:]=|&&|\|\||[-+*/%&|^=!<>:;,.(){}\[\]~])|(?P<bad>[\s\S])"
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_DIRECTIVE = re.compile(r"^//(?:line |extern |export |[a-z0-9]+:[a-z0-9])")


class ScanError(Exception):
    """The source cannot be placed; the message starts with line:column."""


@dataclass
class Comment:
    start: int
    end: int
    text: str


@dataclass
class Token:
    kind: str  # name, keyword, sign, string, number, rune, end
    text: str
    start: int
    end: int
    lead: list[Comment] | None = None


@dataclass
class Field:
    """Names that share a type: a parameter, result or struct field. No names: unnamed or embedded."""

    names: list[str]
    type_start: int
    type_end: int
    type_src: str
    variadic: bool = False
    tag_src: str | None = None
    tag_start: int | None = None
    tag_end: int | None = None


@dataclass
class Member:
    """An interface's method, or (method is None) an embedded type or union."""

    method: str | None
    type_src: str
    params: list[Field] = field(default_factory=list)
    results: list[Field] = field(default_factory=list)
    results_src: str = ""


@dataclass
class Decl:
    kind: str  # func or type
    name: str
    receiver: str = ""
    receiver_src: str = ""
    receiver_var: str = ""
    exported: bool = False
    type_kind: str | None = None
    group_size: int = 1
    doc: str = ""
    spec_doc: str = ""
    spec_documented: bool = False
    doc_start: int = 0
    node_start: int = 0
    node_end: int = 0
    sym_start: int = 0
    sym_end: int = 0
    name_start: int = 0
    line_start: int = 0
    line_end: int = 0
    body_start: int | None = None
    type_src: str = ""
    signature_src: str = ""
    fields: list[Field] = field(default_factory=list)
    members: list[Member] = field(default_factory=list)
    params: list[Field] = field(default_factory=list)
    results: list[Field] = field(default_factory=list)
    results_src: str = ""


@dataclass
class Import:
    path: str
    alias: str


@dataclass
class SourceFile:
    package: str = ""
    package_doc: str = ""
    clause_ok: bool = False
    imports: list[Import] = field(default_factory=list)
    imports_ok: bool = False
    decls: list[Decl] = field(default_factory=list)
    error: str = ""


def is_exported(name: str) -> bool:
    return name[:1].isupper()


def comment_text(group: list[Comment] | None) -> str:
    """The words of a comment group: markers and directives removed, blank lines at the ends dropped and
    inner runs of them reduced to one."""
    lines: list[str] = []
    for c in group or []:
        if c.text.startswith("//"):
            if not _DIRECTIVE.match(c.text):
                body = c.text[2:]
                lines.append((body[1:] if body.startswith(" ") else body).rstrip())
        else:
            lines += [line.rstrip() for line in c.text[2:-2].split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""


class Scanner:
    def __init__(self, source: bytes):
        self.source = source
        self.line_starts = [0, *(m.end() for m in re.finditer(rb"\n", source))]
        self.tokens = self._tokenize()
        self.at = 0

    # -- places -----------------------------------------------------------------------------------
    def line(self, offset: int) -> int:
        low, high = 0, len(self.line_starts)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.line_starts[middle] <= offset else (low, middle)
        return low + 1

    def text(self, start: int, end: int) -> str:
        return self.source[start:end].decode("utf-8", "replace")

    def fail(self, what: str) -> ScanError:
        start = self.tokens[min(self.at, len(self.tokens) - 1)].start
        row = self.line(start)
        return ScanError(f"{row}:{start - self.line_starts[row - 1] + 1}: {what}")

    # -- tokens -----------------------------------------------------------------------------------
    def _tokenize(self) -> list[Token]:
        out: list[Token] = []
        groups: list[list[Comment]] = []  # comment groups since the last token
        ends_line = False  # whether a line end here is a semicolon
        for m in _TOKEN.finditer(self.source):
            kind, start, end = m.lastgroup, m.start(), m.end()
            if kind == "blank":
                continue
            if kind == "comment":
                text = self.text(start, end)
                note = Comment(start, end, text)
                row = self.line(start)
                trailing = bool(out) and not groups and self.line(max(out[-1].end - 1, out[-1].start)) == row
                if trailing:
                    groups.append([])  # a group of its own that documents nothing
                    groups[-1].append(note)
                    groups.append([])
                elif groups and groups[-1] and row <= self.line(groups[-1][-1].end - 1) + 1:
                    groups[-1].append(note)
                elif groups and not groups[-1]:
                    groups[-1].append(note)
                else:
                    groups.append([note])
                if ends_line and b"\n" in m[0]:
                    out.append(Token("sign", ";", start, start))
                    ends_line = False
                continue
            if kind == "line":
                if ends_line:
                    out.append(Token("sign", ";", start, start))
                    ends_line = False
                continue
            text = self.text(start, end)
            if kind == "name" and text in KEYWORDS:
                kind = "keyword"
            if kind == "raw":
                kind = "string"
            last = groups[-1] if groups else []
            lead = last if last and self.line(last[-1].end - 1) + 1 == self.line(start) else None
            out.append(Token(kind, text, start, end, lead))
            groups = []
            ends_line = kind in ("name", "number", "string", "rune") or (kind == "keyword" and text in _ENDING_KEYWORDS) or (kind == "sign" and text in _ENDING_SIGNS)
        size = len(self.source)
        if ends_line:
            out.append(Token("sign", ";", size, size))
        out.append(Token("end", "", size, size))
        return out

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.token
        if token.kind == "bad":
            raise self.fail(f"illegal character {token.text!r}")
        if token.kind != "end":
            self.at += 1
        return token

    def is_sign(self, *texts: str) -> bool:
        return self.token.kind == "sign" and self.token.text in texts

    def is_keyword(self, *texts: str) -> bool:
        return self.token.kind == "keyword" and self.token.text in texts

    def expect(self, text: str) -> Token:
        if self.token.kind not in ("sign", "keyword") or self.token.text != text:
            raise self.fail(f"expected {text!r}, found {self.token.text or 'end of file'!r}")
        return self.next()

    def expect_name(self) -> Token:
        if self.token.kind != "name":
            raise self.fail(f"expected name, found {self.token.text or 'end of file'!r}")
        return self.next()

    def skip_balanced(self) -> Token:
        """Skip from an opening bracket over its closing one, which is returned."""
        wanted = [_OPEN[self.next().text]]
        while True:
            token = self.next()
            if token.kind == "end":
                raise self.fail(f"expected {wanted[-1]!r}, found end of file")
            if token.kind == "sign":
                if token.text in _OPEN:
                    wanted.append(_OPEN[token.text])
                elif token.text in _CLOSE:
                    if token.text != wanted.pop():
                        self.at -= 1
                        raise self.fail(f"unexpected {token.text!r}")
                    if not wanted:
                        return token

    def end_statement(self) -> None:
        if self.is_sign(";"):
            self.next()
        elif self.token.kind != "end" and not self.is_sign(")", "}"):
            raise self.fail(f"expected ';', found {self.token.text!r}")

    # -- files ------------------------------------------------------------------------------------
    def scan(self, level: str = "full") -> SourceFile:
        out = SourceFile()
        try:
            doc = self.expect("package").lead
            out.package = self.expect_name().text
            out.package_doc = comment_text(doc)
            self.end_statement()
            out.clause_ok = True
            if level == "package":
                return out
            while self.is_keyword("import"):
                self.next()
                self._specs(lambda _: self._import(out), None)
            out.imports_ok = True
            if level == "imports":
                return out
            while self.token.kind != "end":
                self._declaration(out)
        except ScanError as e:
            out.error = str(e)
        return out

    def _specs(self, read, doc: list[Comment] | None) -> None:
        """One spec, or a group of them in parentheses; `read` gets each one's own comment group."""
        if self.is_sign("("):
            self.next()
            while not self.is_sign(")"):
                if self.token.kind == "end":
                    raise self.fail("expected ')', found end of file")
                read(self.token.lead)
                self.end_statement()
            self.next()
        else:
            read(doc)
        self.end_statement()

    def _import(self, out: SourceFile) -> None:
        alias = ""
        if self.token.kind == "name" or self.is_sign("."):
            alias = self.next().text
        if self.token.kind != "string":
            raise self.fail("missing import path")
        out.imports.append(Import(self.next().text.strip('"`'), alias))

    def _declaration(self, out: SourceFile) -> None:
        if self.is_keyword("func"):
            out.decls.append(self._function())
            self.end_statement()
        elif self.is_keyword("type"):
            self._types(out)
        elif self.is_keyword("const", "var"):
            self.next()
            while not (self.is_sign(";") or self.token.kind == "end"):
                if self.is_sign("(", "[", "{"):
                    self.skip_balanced()
                elif self.is_sign(")", "]", "}"):
                    raise self.fail(f"unexpected {self.token.text!r}")
                else:
                    self.next()
            self.end_statement()
        elif self.is_keyword("import"):
            raise self.fail("imports must appear before other declarations")
        else:
            raise self.fail("expected declaration")

    # -- functions --------------------------------------------------------------------------------
    def _function(self) -> Decl:
        first = self.expect("func")
        d = Decl("func", "")
        if self.is_sign("("):
            opening = self.token.start
            receivers, closing = self._parameters()
            if receivers:
                d.receiver_src = receivers[0].type_src
                d.receiver_var = receivers[0].names[0] if receivers[0].names else ""
                m = re.fullmatch(r"\*?\s*([^\W\d]\w*)", d.receiver_src)
                d.receiver = m[1] if m else ""
            else:
                d.receiver_src = self.text(opening, closing)
        d.name = self.expect_name().text
        d.exported = is_exported(d.name)
        d.name_start = self.tokens[self.at - 1].start
        if self.is_sign("["):
            self.skip_balanced()
        sign_start = self.token.start
        d.params, _ = self._parameters()
        d.results, d.results_src = self._results()
        end = self.tokens[self.at - 1].end
        d.signature_src = self.text(sign_start, end)
        if self.is_sign("{"):
            d.body_start = self.token.start
            end = self.skip_balanced().end
        d.node_start = d.sym_start = first.start
        d.doc_start = first.lead[0].start if first.lead else first.start
        d.node_end = d.sym_end = end
        d.doc = comment_text(first.lead)
        d.line_start, d.line_end = self.line(first.start), self.line(end)
        return d

    def _parameters(self) -> tuple[list[Field], int]:
        """Fields of a list in parentheses, and where it ends."""
        self.expect("(")
        entries: list[tuple[int, int]] = []  # token ranges between commas
        while not self.is_sign(")"):
            begin = self.at
            while not self.is_sign(",", ")"):
                if self.token.kind == "end":
                    raise self.fail("expected ')', found end of file")
                if self.is_sign(";"):
                    raise self.fail("missing ',' in parameter list")
                if self.is_sign("(", "[", "{"):
                    self.skip_balanced()
                else:
                    self.next()
            entries.append((begin, self.at))
            if self.is_sign(","):
                self.next()
        end = self.next().end
        return self._group(entries), end

    def _group(self, entries: list[tuple[int, int]]) -> list[Field]:
        named = [self._is_named(b, e) for b, e in entries]
        out: list[Field] = []
        if not any(named):
            for b, e in entries:
                out.append(self._typed([], b, e))
            return out
        names: list[str] = []
        for (b, e), has_type in zip(entries, named, strict=True):
            names.append(self.tokens[b].text)
            if has_type:
                out.append(self._typed(names, b + 1, e))
                names = []
        return out

    def _is_named(self, begin: int, end: int) -> bool:
        if self.tokens[begin].kind != "name" or end - begin < 2:
            return False
        second = self.tokens[begin + 1]
        if second.kind == "sign" and second.text == ".":
            return False
        if second.kind == "sign" and second.text == "[":
            return self._is_type(begin + 1, end)
        return True

    def _is_type(self, begin: int, end: int) -> bool:
        """Whether the tokens are one whole type."""
        back = self.at
        self.at = begin
        try:
            self._type()
            return self.at == end
        except ScanError:
            return False
        finally:
            self.at = back

    def _typed(self, names: list[str], begin: int, end: int) -> Field:
        variadic = self.tokens[begin].text == "..." and begin + 1 < end
        if variadic:
            begin += 1
        start, stop = self.tokens[begin].start, self.tokens[end - 1].end
        return Field(list(names), start, stop, self.text(start, stop), variadic)

    def _results(self) -> tuple[list[Field], str]:
        if self.is_sign("("):
            start = self.token.start
            fields, end = self._parameters()
            if len(fields) == 1 and not fields[0].names:
                return fields, fields[0].type_src
            return fields, self.text(start, end) if fields else ""
        if self._type_starts():
            start = self.token.start
            self._type()
            end = self.tokens[self.at - 1].end
            src = self.text(start, end)
            return [Field([], start, end, src)], src
        return [], ""

    # -- types ------------------------------------------------------------------------------------
    def _type_starts(self) -> bool:
        return self.token.kind == "name" or self.is_sign("*", "[", "(", "<-") or self.is_keyword("map", "chan", "func", "struct", "interface")

    def _type(self) -> None:
        if self.token.kind == "name":
            self.next()
            if self.is_sign("."):
                self.next()
                self.expect_name()
            if self.is_sign("[") and not (self.peek().kind == "sign" and self.peek().text == "]"):
                self.skip_balanced()  # type arguments
        elif self.is_sign("*", "<-", "~"):
            self.next()
            self._type()
        elif self.is_sign("("):
            self.next()
            self._type()
            self.expect(")")
        elif self.is_sign("["):
            self.skip_balanced()
            self._type()
        elif self.is_keyword("map"):
            self.next()
            if not self.is_sign("["):
                raise self.fail("expected '['")
            self.skip_balanced()
            self._type()
        elif self.is_keyword("chan"):
            self.next()
            if self.is_sign("<-"):
                self.next()
            self._type()
        elif self.is_keyword("func"):
            self.next()
            self._parameters()
            self._results()
        elif self.is_keyword("struct", "interface"):
            self.next()
            if not self.is_sign("{"):
                raise self.fail("expected '{'")
            self.skip_balanced()
        else:
            raise self.fail(f"expected type, found {self.token.text or 'end of file'!r}")

    def _types(self, out: SourceFile) -> None:
        first = self.expect("type")
        made: list[Decl] = []
        grouped = self.is_sign("(")
        specs_at = len(out.decls)

        def read(doc: list[Comment] | None) -> None:
            made.append(self._type_spec(doc if grouped else None))

        if grouped:
            self.next()
            while not self.is_sign(")"):
                if self.token.kind == "end":
                    raise self.fail("expected ')', found end of file")
                read(self.token.lead)
                self.end_statement()
            end = self.next().end
        else:
            read(None)
            end = self.tokens[self.at - 1].end
        self.end_statement()
        for d in made:
            d.group_size = len(made)
            if len(made) == 1:
                d.doc = comment_text(first.lead)
                d.node_start, d.node_end = first.start, end
                d.doc_start = first.lead[0].start if first.lead else first.start
                if first.lead and not d.spec_documented:
                    d.sym_start = first.lead[0].start
            d.line_start, d.line_end = self.line(d.sym_start), self.line(d.sym_end)
        out.decls[specs_at:] = made

    def _type_spec(self, doc: list[Comment] | None) -> Decl:
        name = self.expect_name()
        d = Decl("type", name.text, exported=is_exported(name.text))
        d.spec_doc = comment_text(doc)
        d.spec_documented = doc is not None
        d.name_start = d.sym_start = d.node_start = name.start
        d.doc_start = doc[0].start if doc else name.start
        if self.is_sign("[") and self._has_type_parameters():
            self.skip_balanced()
        if self.is_sign("="):
            self.next()
        start = self.token.start
        d.type_kind = "other"
        if self.is_keyword("struct") and self.peek().text == "{":
            d.type_kind = "struct"
            self.next()
            d.fields = self._struct()
        elif self.is_keyword("interface") and self.peek().text == "{":
            d.type_kind = "interface"
            self.next()
            d.members = self._interface()
        else:
            self._type()
        end = self.tokens[self.at - 1].end
        d.type_src = self.text(start, end)
        d.sym_end = d.node_end = end
        return d

    def _has_type_parameters(self) -> bool:
        second, third = self.peek(), self.peek(2)
        if second.kind != "name":
            return False
        return third.kind in ("name", "keyword") or (third.kind == "sign" and third.text in (",", "~", "[", "*"))

    def _struct(self) -> list[Field]:
        self.expect("{")
        out: list[Field] = []
        while not self.is_sign("}"):
            if self.token.kind == "end":
                raise self.fail("expected '}', found end of file")
            names: list[str] = []
            if self._named_field():
                names.append(self.expect_name().text)
                while self.is_sign(","):
                    self.next()
                    names.append(self.expect_name().text)
            start = self.token.start
            self._type()
            end = self.tokens[self.at - 1].end
            item = Field(names, start, end, self.text(start, end))
            if self.token.kind == "string":
                tag = self.next()
                item.tag_src, item.tag_start, item.tag_end = tag.text, tag.start, tag.end
            out.append(item)
            self.end_statement()
        self.next()
        return out

    def _named_field(self) -> bool:
        if self.token.kind != "name":
            return False
        second = self.peek()
        if second.kind == "string" or (second.kind == "sign" and second.text in (".", ";", "}")):
            return False
        if second.kind == "sign" and second.text == "[":
            back = self.at
            self.at += 1
            try:
                self.skip_balanced()
                return not (self.token.kind == "string" or self.is_sign(";", "}"))
            finally:
                self.at = back
        return True

    def _interface(self) -> list[Member]:
        self.expect("{")
        out: list[Member] = []
        while not self.is_sign("}"):
            if self.token.kind == "end":
                raise self.fail("expected '}', found end of file")
            if self.token.kind == "name" and self.peek().kind == "sign" and self.peek().text == "(":
                name = self.next().text
                start = self.token.start
                params, _ = self._parameters()
                results, results_src = self._results()
                out.append(Member(name, self.text(start, self.tokens[self.at - 1].end), params, results, results_src))
            else:
                start = self.token.start
                self._type()
                while self.is_sign("|"):
                    self.next()
                    self._type()
                out.append(Member(None, self.text(start, self.tokens[self.at - 1].end)))
            self.end_statement()
        self.next()
        return out


def scan(source: bytes, level: str = "full") -> SourceFile:
    """Scan a whole file, or its `imports` or `package` clause only."""
    return Scanner(source).scan(level)


def fragment(content: str) -> SourceFile:
    """Scan declarations without a package clause."""
    return scan(b"package p\n" + content.encode())
