"""Text rules of the edits and generators, without Spark: identifiers, documentation, tags, generated code."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from canopy.functions.goscan import Decl, Field, Member, SourceFile, fragment, is_exported
from canopy.functions.gotypes import results_string

# -- errors -----------------------------------------------------------------------------------------
#: The error codes and what they say.
MESSAGES = {
    "INVALID_ACTION": "invalid action",
    "ACTION_LIMIT_EXCEEDED": "action limit exceeded",
    "FILE_NOT_FOUND": "file not found",
    "FILE_ALREADY_EXISTS": "file already exists",
    "NODE_NOT_FOUND": "node not found",
    "NODE_ALREADY_EXISTS": "node already exists",
}
HINTS = {
    "FILE_NOT_FOUND": "check the path, or create the file first",
    "FILE_ALREADY_EXISTS": "replace the file instead of creating it",
    "NODE_NOT_FOUND": "look the symbol up to find its exact identifier",
    "NODE_ALREADY_EXISTS": "update the declaration instead of adding it",
    "PARSE_ERROR": "make the source parse first",
}


class EngineError(Exception):
    """A failure with a code."""

    def __init__(self, code: str, message: str = ""):
        self.code, self.message = code, message or MESSAGES.get(code, "")
        super().__init__(f"[{self.code}] {self.message}")

    @property
    def hint(self) -> str:
        return HINTS.get(self.code, "")


class EmptyPlan(Exception):
    """A plan without actions."""


# -- identifiers ------------------------------------------------------------------------------------
def parse_identifier(identifier: str) -> tuple[str, str]:
    """(receiver, name). Three parts are package, receiver, name; four or more are read like two."""
    parts = identifier.split(".")
    if len(parts) == 1:
        return "", identifier
    owner, name = (parts[1], parts[2]) if len(parts) == 3 else (parts[0], parts[1])
    return owner.strip("()*"), name


def base_name(receiver: str) -> str:
    return receiver.removeprefix("*")


def capitalised(name: str) -> str:
    return name[:1].upper() + name[1:]


def camel_name(name: str) -> str:
    return "id" if name == "ID" else name[:1].lower() + name[1:]


def snake_name(name: str) -> str:
    name = re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def first_type_name(source: str) -> str:
    for line in source.split("\n"):
        words = line.split()
        if line.strip().startswith("type ") and len(words) >= 2:
            return words[1]
    return "interface"


def first_identifier(source: str) -> str:
    """The name that a snippet declares, for messages: `name`, `Receiver.name` or `content`."""
    for line in source.split("\n"):
        if m := re.match(r"\s*func\s+\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*(\w+)", line):
            return f"{m[1]}.{m[2]}"
        if m := re.match(r"\s*(?:func|type)\s+(\w+)", line):
            return m[1]
    return "content"


def first_quoted(text: str) -> str:
    m = re.search(r'"([^"]*)"', text)
    return m[1] if m else ""


# -- documentation ----------------------------------------------------------------------------------
def doc_comment(text: str) -> str:
    return "\n".join(f"// {line}" if line else "//" for line in text.split("\n")).rstrip("\n")


def placed(decl: Decl, content: str, doc: str, strip_doc: bool) -> tuple[int, str]:
    """Where the replacement of a declaration starts, and its text: the old documentation stays unless
    a new one is given or it is to go."""
    if doc:
        return decl.doc_start, f"{doc_comment(doc)}\n{content}"
    return (decl.doc_start if strip_doc else decl.node_start), content


def with_package(content: str, package: str) -> str:
    from canopy.functions.goscan import scan

    parsed = scan(content.encode())
    return content if (parsed.clause_ok and not parsed.error) or not package else f"package {package}\n\n{content}"


# -- locating ---------------------------------------------------------------------------------------
def find_function(parsed: SourceFile, identifier: str) -> Decl | None:
    owner, name = parse_identifier(identifier)
    return next((d for d in parsed.decls if d.kind == "func" and d.name == name and (d.receiver == owner or (not d.receiver and owner == parsed.package))), None)


def find_type(parsed: SourceFile, identifier: str) -> Decl | None:
    package, name = parse_identifier(identifier)
    if package and package != parsed.package:
        return None
    return next((d for d in parsed.decls if d.kind == "type" and d.name == name), None)


def declared_function(content: str) -> str:
    """The first function that a snippet declares, as an identifier; empty if none or it does not scan."""
    parsed = fragment(content)
    if parsed.error:
        return ""
    return next((f"{d.receiver}.{d.name}" if d.receiver else d.name for d in parsed.decls if d.kind == "func"), "")


def declared_type(content: str) -> str:
    parsed = fragment(content)
    return "" if parsed.error else next((d.name for d in parsed.decls if d.kind == "type"), "")


# -- struct tags ------------------------------------------------------------------------------------
def tag_value(tag: str, key: str) -> str:
    """The value of a key in a struct tag of the conventional form; empty if absent."""
    for m in re.finditer(r'\s*([^\s":]+):"((?:[^"\\]|\\.)*)"', tag):
        if m[1] == key:
            return m[2]
    return ""


def merged_tag(existing: str, addition: str) -> str:
    if not existing:
        return addition
    return existing if tag_value(existing, addition.partition(":")[0]) else f"{existing} {addition}"


def tag_edits(struct: Decl, field_name: str = "", set_tag: str = "", auto: str = "") -> list[tuple[int, int, str]]:
    """(start, end, text) of every tag that changes."""
    edits = []
    for f in struct.fields:
        if not f.names or (field_name and f.names[0] != field_name) or (auto and not is_exported(f.names[0])):
            continue
        old = f.tag_src or ""
        if len(old) >= 2 and old[0] == old[-1] == "`":
            old = old[1:-1]
        new = old
        if set_tag:
            new = set_tag if field_name else merged_tag(old, set_tag)
        elif auto:
            shown = camel_name(f.names[0]) if auto == "json" else snake_name(f.names[0])
            new = merged_tag(old, f'{auto}:"{shown}"')
        if new != old:
            edits.append((f.tag_start, f.tag_end, f"`{new}`") if f.tag_src is not None else (f.type_end, f.type_end, f" `{new}`"))
    return edits


def spliced(source: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    """Apply edits of byte ranges, the last range first so that the earlier offsets hold."""
    for start, end, text in sorted(edits, key=lambda e: -e[0]):
        source = source[:start] + text.encode() + source[end:]
    return source


# -- generated code ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Param:
    name: str
    type: str
    variadic: bool = False


@dataclass(frozen=True)
class Method:
    name: str
    params: tuple[Param, ...]
    results: tuple[Param, ...]
    results_src: str = ""  # as the source has them

    def parameters(self) -> str:
        return "(" + ", ".join(f"{p.name or f'p{i}'} {'...' if p.variadic else ''}{p.type}" for i, p in enumerate(self.params)) + ")"

    def arguments(self) -> str:
        return ", ".join((p.name or f"p{i}") + ("..." if p.variadic else "") for i, p in enumerate(self.params))

    def tuple_type(self, dots: bool = True) -> str:
        """The parameters as a type writes them, unnamed ones without a name; without dots the last of a variadic
        list is the slice that it is inside the function."""
        rest = "..." if dots else "[]"
        return "(" + ", ".join(f"{p.name + ' ' if p.name else ''}{rest if p.variadic else ''}{p.type}" for p in self.params) + ")"

    def results_type(self, bare: bool = False) -> str:
        """The results as a signature ends; `bare`: a single one without its name."""
        if bare and len(self.results) == 1:
            return self.results[0].type
        return results_string([(p.name, p.type) for p in self.results])


def params_of(fields: list[Field]) -> tuple[Param, ...]:
    return tuple(Param(name, f.type_src, f.variadic) for f in fields for name in (f.names or [""]))


def width(fields: list[Field]) -> int:
    return sum(max(1, len(f.names)) for f in fields)


def method_of(m: Member) -> Method:
    return Method(m.method or "", params_of(m.params), params_of(m.results), m.results_src)


#: The lines of a mock, a stub and a test skeleton.
def mock_source(package: str, mock: str, methods: list[Method], iface_package: str, iface: str, typed: bool) -> str:
    """A struct of function fields that satisfies an interface. `typed`: types as a type checker prints them, else as
    the source writes them."""
    mock = base_name(mock)
    out = [f"package {package}\n\n", f"type {mock} struct {{\n"]
    for m in methods:
        ending = m.results_type()
        kind = f"func{m.tuple_type()}{' ' + ending if ending else ''}" if typed else f"func{m.parameters()} {m.results_src}"
        out.append(f"\t{m.name}Func {kind}\n")
    out.append("}\n")
    for m in methods:
        back = "return " if m.results else ""
        results = m.results_type(bare=True) if typed else m.results_src
        out.append(f"\nfunc (m *{mock}) {m.name}{m.parameters()} {results} {{\n\tif m.{m.name}Func == nil {{\n")
        out.append(f'\t\tpanic("{mock}.{m.name}Func not set")\n\t}}\n\t{back}m.{m.name}Func({m.arguments()})\n}}\n')
    owner = iface if package == iface_package else f"{iface_package}.{iface}"
    out.append(f"\nvar _ {owner} = (*{mock})(nil)\n")
    return "".join(out)


def interface_in(content: str) -> Decl:
    """The first interface that a snippet declares."""
    parsed = fragment(content)
    if parsed.error:
        raise EngineError("PARSE_ERROR", f"failed to parse interface source: {parsed.error}")
    found = next((d for d in parsed.decls if d.type_kind == "interface"), None)
    if found is None:
        raise EngineError("NOT_FOUND", "no interface type declaration found in source")
    return found


def mock_from_source(content: str, mock: str, package: str, iface_package: str) -> tuple[str, int]:
    """Mock of the interface that a snippet declares, embedded interfaces left out; and its methods."""
    iface = interface_in(content)
    methods = [method_of(m) for m in iface.members if m.method is not None]
    return mock_source(package, mock, methods, iface_package, iface.name, typed=False), len(methods)


def stub(interface: str, receiver: str, m: Method) -> str:
    """A method that is still to be written, in formatted form."""
    head = " ".join(filter(None, [f"func (r {receiver}) {m.name}{m.tuple_type(dots=False)}", m.results_type()]))
    return f'\n// {m.name} implements {interface}.\n{head} {{\n\t// TODO: implement {m.name}\n\tpanic("not implemented")\n}}\n'


def interface_source(name: str, methods: list[tuple[str, str]]) -> str:
    """An interface of (method name, signature) pairs."""
    return f"type {name} interface {{\n" + "".join(f"\t{m}{sign}\n" for m, sign in methods) + "}"


def test_path(path: str) -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}_test{ext}"


def test_header(package: str) -> str:
    names = ("testing", "github.com/stretchr/testify/assert", "github.com/stretchr/testify/require")
    return f"package {package}_test\n\nimport (\n" + "".join(f'\t"{n}"\n' for n in names) + ")\n\n"


def test_skeleton(decl: Decl, identifier: str) -> str:
    """A table-driven test of a function, without cases."""
    owner, name = parse_identifier(identifier)
    title = f"Test{capitalised(owner)}_{capitalised(name)}" if owner else f"Test{capitalised(name)}"
    params = [(n, ("..." if f.variadic else "") + f.type_src) for i, f in enumerate(decl.params) for n in (f.names or [f"arg{i}"])]
    wants = [(n, f.type_src) for i, f in enumerate(decl.results) if f.type_src != "error" for n in ([f"want{capitalised(x)}" for x in f.names] or [f"want{i}"])]
    fails = any(f.type_src == "error" for f in decl.results)
    var = (decl.receiver_var or "recv") if decl.receiver_src else ""
    rows = [f"func {title}(t *testing.T) {{"]
    if params:
        rows += ["\ttype args struct {", *(f"\t\t{n} {t}" for n, t in params), "\t}"]
    rows += ["\ttests := []struct {", "\t\tname string"]
    if var:
        rows.append(f"\t\t{var} {decl.receiver_src}")
    if params:
        rows.append("\t\targs args")
    rows += [f"\t\t{n} {t}" for n, t in wants]
    if fails:
        rows.append("\t\twantErr bool")
    rows += ["\t}{", "\t\t// TODO: Add test cases.", "\t}", "\tif len(tests) == 0 {", f'\t\tt.Skip("TODO: no test cases defined for {title}")', "\t}"]
    rows += ["\tfor _, tt := range tests {", "\t\tt.Run(tt.name, func(t *testing.T) {"]
    got = ["got"] if len(wants) == 1 else [f"got{i}" for i in range(len(wants))]
    call = f"{f'tt.{var}.' if var else ''}{name}({', '.join(f'tt.args.{n}' for n, _ in params)})"
    left = got + ["err"] * fails
    rows.append(f"\t\t\t{', '.join(left)} := {call}" if left else f"\t\t\t{call}")
    if fails:
        rows += ["\t\t\tif tt.wantErr {", "\t\t\t\tassert.Error(t, err)", "\t\t\t\treturn", "\t\t\t}", "\t\t\trequire.NoError(t, err)"]
    rows += [f"\t\t\tassert.Equal(t, tt.{n}, {g})" for (n, _), g in zip(wants, got, strict=True)]
    return "\n".join([*rows, "\t\t})", "\t}", "}", ""])
