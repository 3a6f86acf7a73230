"""Ordered edits of one tree, without Spark. Paths map to bytes; the first failure stops, earlier edits stay."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from canopy.functions import gotext as g
from canopy.functions.goscan import Decl, SourceFile, scan

#: The actions of a plan.
ACTIONS = (
    "create_file", "replace_file", "add_func", "update_func", "delete_func", "add_struct", "update_struct", "delete_struct",
    "add_interface", "update_interface", "delete_interface",
)


@dataclass
class Action:
    action: str
    file: str
    package: str = ""
    identifier: str = ""
    content: str = ""
    mock_file: str = ""
    mock_name: str = ""
    doc: str = ""
    strip_doc: bool = False


@dataclass
class Outcome:
    """What a plan did: counts distinct target files; generated mocks are not counted."""

    files_modified: int = 0
    warnings: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    failed_seq: int | None = None
    error_code: str = ""
    error_message: str = ""


def clean(path: str) -> str:
    return os.path.normpath(path)


def parent(path: str) -> str:
    return os.path.dirname(clean(path)) or "."


class Tree:
    """The files of a tree, with the changes made to it."""

    def __init__(self, files: dict[str, bytes], root_name: str = ""):
        self.files, self.changed, self.root_name = {clean(p): c for p, c in files.items()}, set(), root_name

    def write(self, path: str, content: bytes) -> None:
        self.files[clean(path)] = content
        self.changed.add(clean(path))

    def siblings(self, path: str) -> list[str]:
        """Production files in the directory of a path, by name."""
        home = parent(path)
        return sorted(p for p in self.files if parent(p) == home and p.endswith(".go") and not p.endswith("_test.go"))

    def package_of(self, path: str) -> str:
        """Package name of the first sibling whose clause can be read, else the directory's name."""
        for p in self.siblings(path):
            if (parsed := scan(self.files[p], "package")).clause_ok:
                return parsed.package
        home = os.path.basename(parent(path))
        return home if home not in ("", ".") else self.root_name

    def inferred_package(self, path: str) -> str:
        for p in self.siblings(path):
            if not (parsed := scan(self.files[p])).error:
                return parsed.package
        return ""

    # -- actions ----------------------------------------------------------------------------------
    def run(self, actions: list[tuple[int, Action]]) -> Outcome:
        if not actions:
            raise g.EmptyPlan("plan has no actions")
        out = Outcome()
        done: set[str] = set()
        for seq, action in sorted(actions, key=lambda a: a[0]):
            try:
                warnings, message = self.apply(action)
            except g.EngineError as e:
                out.failed_seq, out.error_code, out.error_message = seq, e.code, e.message
                break
            if not action.action.endswith("_interface"):
                out.warnings += warnings
            out.messages.append(message)
            done.add(action.file)
        out.files_modified = len(done)
        return out

    def apply(self, a: Action) -> tuple[list[str], str]:
        if a.action == "create_file":
            return self._create(a)
        if a.action == "replace_file":
            return self._replace(a)
        if a.action.endswith("_interface"):
            return self._interface(a)
        if a.action in ACTIONS:
            return self._declaration(a)
        raise g.EngineError("INVALID_ACTION", f"invalid action type: {a.action}")

    def _create(self, a: Action) -> tuple[list[str], str]:
        if clean(a.file) in self.files:
            raise g.EngineError("FILE_ALREADY_EXISTS")
        self.write(a.file, g.with_package(a.content, a.package or self.inferred_package(a.file)).encode())
        return [], f"created {a.file}"

    def _replace(self, a: Action) -> tuple[list[str], str]:
        if clean(a.file) not in self.files:
            raise g.EngineError("FILE_NOT_FOUND")
        parsed = scan(self.files[clean(a.file)])
        if parsed.error or not parsed.clause_ok:
            raise g.EngineError("PARSE_ERROR", f"failed to determine package name from existing file {a.file}")
        self.write(a.file, g.with_package(a.content, parsed.package).encode())
        return [], f"replaced {a.file}"

    def _declaration(self, a: Action) -> tuple[list[str], str]:
        verb, kind = a.action.split("_")
        source = self.files.get(clean(a.file))
        is_new = source is None
        if is_new:
            if verb != "add":
                raise g.EngineError("FILE_NOT_FOUND")
            source = f"package {a.package}\n".encode()
        parsed = scan(source)
        if parsed.error:
            raise g.EngineError("PARSE_ERROR", f"failed to parse file: {a.file}:{parsed.error}")
        find = g.find_function if kind == "func" else g.find_type
        warnings: list[str] = []
        if verb == "add":
            name = "" if is_new else (g.declared_function if kind == "func" else g.declared_type)(a.content)
            if name and (old := find(parsed, name)):
                shown = source[old.doc_start : old.node_end].decode("utf-8", "replace").strip()
                raise g.EngineError("NODE_ALREADY_EXISTS", f'{"function" if kind == "func" else "struct"} "{name}" already declared in {a.file}:\n\n{shown}')
            source = appended(source, a.content)
        elif verb == "update":
            if old := find(parsed, a.identifier):
                start, text = g.placed(old, a.content, a.doc, a.strip_doc)
                source = g.spliced(source, [(start, old.node_end, text)])
            else:
                source = appended(source, f"{g.doc_comment(a.doc)}\n{a.content}" if a.doc else a.content)
                warnings.append(f'{a.action}: identifier "{a.identifier}" not found in {a.file}, treated as add_{kind}')
        else:
            gone = self._doomed(parsed, a.identifier, kind)
            if not gone:
                raise g.EngineError("NODE_NOT_FOUND")
            source = g.spliced(source, [(d.doc_start, d.node_end, "") for d in gone])
        self.write(a.file, source)
        return warnings, f"{a.action} {a.identifier or g.first_identifier(a.content)} in {a.file}"

    @staticmethod
    def _doomed(parsed: SourceFile, identifier: str, kind: str) -> list[Decl]:
        if kind == "func":
            found = g.find_function(parsed, identifier)
            return [found] if found else []
        found = g.find_type(parsed, identifier)
        methods = [d for d in parsed.decls if d.kind == "func" and d.receiver_src and d.receiver == identifier]
        return ([found] if found else []) + methods

    def _interface(self, a: Action) -> tuple[list[str], str]:
        verb = a.action.split("_")[0]
        base = os.path.basename(a.file)
        plain = Action(f"{verb}_struct", a.file, "", a.identifier, a.content, doc=a.doc, strip_doc=a.strip_doc)
        if verb == "add":
            plain.identifier = plain.doc = ""
            plain.strip_doc = False
        warnings, _ = self._declaration(plain)
        name = g.first_type_name(a.content)
        if verb == "delete":
            return [], f"SUCCESS: Deleted {a.identifier} from {base}"
        if verb == "add":
            message, joint = f"Added {name} to {base}", ", "
        elif warnings:
            shown = "new declaration" if name == "interface" else name
            message, joint = f"SUCCESS: Added {shown} to {base} (NOTE: '--id {a.identifier}' not found, content was appended as a new declaration)", ", regenerated "
        else:
            message, joint = f"SUCCESS: Updated {a.identifier} in {base}", ", regenerated "
        if a.mock_file and a.mock_name:
            message += joint + self.mock_from_source(a.content, a.mock_name, a.mock_file, a.file)
        return warnings, message + "".join(f"\nWARNING (update-interface): {w}" for w in warnings)

    def mock_from_source(self, content: str, mock: str, mock_file: str, iface_file: str) -> str:
        text, n = g.mock_from_source(content, mock, self.package_of(mock_file), self.package_of(iface_file))
        self.write(mock_file, text.encode())
        return f"Generated {g.base_name(mock)} ({n} methods) in {mock_file}"

    # -- other commands ---------------------------------------------------------------------------
    def _parsed(self, path: str) -> tuple[bytes, SourceFile]:
        source = self.files.get(clean(path))
        if source is None:
            raise g.EngineError("READ_ERROR", "failed to read file")
        parsed = scan(source)
        if parsed.error:
            raise g.EngineError("PARSE_ERROR", f"failed to parse file: {path}:{parsed.error}")
        return source, parsed

    def tag(self, path: str, struct: str, field_name: str = "", set_tag: str = "", auto: str = "") -> str:
        source, parsed = self._parsed(path)
        found = [d for d in parsed.decls if d.type_kind == "struct" and d.name == struct]
        if not found:
            raise g.EngineError("NOT_FOUND", f"struct '{struct}' not found")
        edits = g.tag_edits(found[-1], field_name, set_tag, auto)
        if edits:
            self.write(path, g.spliced(source, edits))
        return f"tagged {len(edits)} fields of {struct}"

    def test(self, path: str, identifier: str) -> str:
        _, parsed = self._parsed(path)
        owner, name = g.parse_identifier(identifier)
        found = next((d for d in parsed.decls if d.kind == "func" and d.name == name and (d.receiver == owner if owner else not d.receiver_src) and bool(owner) == bool(d.receiver_src)), None)
        if found is None:
            raise g.EngineError("NOT_FOUND", f"function '{identifier}' not found")
        target = g.test_path(path)
        old = self.files.get(clean(target), g.test_header(parsed.package).encode())
        self.write(target, old + b"\n" + g.test_skeleton(found, identifier).encode())
        return target

    def extract(self, path: str, struct: str, name: str, out: str = "", mock_file: str = "", mock_name: str = "") -> str:
        methods = []
        for p in self.siblings(path):
            _, parsed = self._parsed(p)
            methods += [(d.name, d.signature_src) for d in parsed.decls if d.kind == "func" and d.receiver == struct and d.receiver_src and d.exported]
        if not methods:
            raise g.EngineError("NOT_FOUND", f"no exported methods found for struct '{struct}'")
        _, message = self._interface(Action("add_interface", out or path, content=g.interface_source(name, methods), mock_file=mock_file, mock_name=mock_name))
        return message


def appended(source: bytes, content: str) -> bytes:
    if source and not source.endswith(b"\n"):
        source += b"\n"
    return source + f"\n{content}\n".encode()
