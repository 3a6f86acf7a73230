"""The declaration scanner by itself."""

from __future__ import annotations

import pytest

from canopy.functions.goscan import comment_text, fragment, scan
from canopy.functions.gotext import params_of


def decls(body: str):
    parsed = fragment(body)
    assert not parsed.error, parsed.error
    return parsed.decls


def test_strings_comments_and_runes_hide_brackets():
    (f,) = decls("func F() {\n\ta := \"}\"; b := `}\n}`; c := '}'; /* } */ // }\n\t_ = a + b\n}\n")
    assert f.name == "F" and f.body_start is not None


def test_body_is_not_the_first_brace():
    (f,) = decls("func F(a struct{ X int }, b interface{ M() }) (c map[string]struct{}) {\n}\n")
    assert f.params[0].type_src == "struct{ X int }" and f.results[0].names == ["c"]
    assert fragment("func F(a struct{}) int\nfunc G() {}\n").decls[0].body_start is None


@pytest.mark.parametrize(
    ("params", "expected"),
    [
        ("a, b int, c ...string", [("a", "int", False), ("b", "int", False), ("c", "string", True)]),
        ("int, string", [("", "int", False), ("", "string", False)]),
        ("f func(x, y int) (int, error), m map[K][]V", [("f", "func(x, y int) (int, error)", False), ("m", "map[K][]V", False)]),
        ("List[int], pkg.T", [("", "List[int]", False), ("", "pkg.T", False)]),
        ("a [5]int, ch <-chan int", [("a", "[5]int", False), ("ch", "<-chan int", False)]),
        ("...int", [("", "int", True)]),
        ("", []),
    ],
)
def test_parameters(params, expected):
    (f,) = decls(f"func F({params}) {{}}")
    assert [(p.name, p.type, p.variadic) for p in params_of(f.params)] == expected


@pytest.mark.parametrize(("receiver", "name"), [("s *S", "S"), ("s S", "S"), ("*S", "S"), ("s *S[T]", ""), ("s S[T]", "")])
def test_receivers(receiver, name):
    (f,) = decls(f"func ({receiver}) M() {{}}")
    assert f.receiver == name and f.name == "M"


def test_documentation_touches_its_declaration():
    source = "// far\n\n// near\n//go:noinline\n// more\nfunc F() {} // trailing\nfunc G() {}\n"
    f, h = decls(source)
    assert f.doc == "near\nmore\n" and h.doc == ""
    shift = len("package p\n")
    assert f.doc_start == shift + source.index("// near") and f.node_end == shift + source.index(" // trailing")


def test_grouped_types_have_their_own_documentation_and_ranges():
    source = "// group\ntype (\n\t// one\n\tA struct{}\n\tB = int\n)\n\n// alone\ntype (\n\tC int\n)\n"
    a, b, alone = decls(source)
    assert (a.spec_doc, b.spec_doc, a.group_size) == ("one\n", "", 2)
    assert b.type_src == "int" and alone.group_size == 1 and alone.doc == "alone\n"
    assert source[alone.node_start - 10 : alone.node_end - 10] == "type (\n\tC int\n)"


def test_struct_fields_tags_and_embedding():
    (t,) = decls("type T struct {\n\tA, B int `x:\"y\"`\n\t*pkg.E\n\tG[int]\n\tC [3]string\n\tD \"quoted\"\n}\n")
    assert [f.names for f in t.fields] == [["A", "B"], [], [], ["C"], []]
    assert t.fields[0].tag_src == '`x:"y"`' and t.fields[3].type_src == "[3]string" and t.fields[4].type_src == "D"


def test_interface_members():
    (i,) = decls("type I interface {\n\tM(a int) error\n\tio.Reader\n\t~int | ~string\n}\n")
    assert [(m.method, m.type_src) for m in i.members] == [("M", "(a int) error"), (None, "io.Reader"), (None, "~int | ~string")]


def test_type_parameters_and_arrays():
    kinds = {d.name: (d.type_kind, d.type_src) for d in decls("type A[P any, Q ~int] struct{}\ntype B [4]int\ntype C []A[int]\ntype D[T interface{ M() }] interface{}\ntype N [Size]int\n")}
    assert kinds == {"A": ("struct", "struct{}"), "B": ("other", "[4]int"), "C": ("other", "[]A[int]"), "D": ("interface", "interface{}"), "N": ("other", "[Size]int")}


def test_constants_and_variables_are_skipped():
    (f,) = decls("const (\n\tA = iota\n\tB\n)\nvar x = func() int { return 1 }()\nvar y = T{\n\t1,\n}\nfunc F() {}\n")
    assert f.name == "F"


def test_header_survives_a_broken_body():
    parsed = scan(b'// Package p is.\npackage p\n\nimport (\n\t"a/b"\n\tx "c"\n)\n\nfunc F( {\n')
    assert parsed.package == "p" and parsed.imports_ok and [(i.path, i.alias) for i in parsed.imports] == [("a/b", ""), ("c", "x")]
    assert parsed.error and scan(b"package p\nfunc").error and scan(b"func F() {}").error
    assert not scan(b"package p\nfunc F( {", "imports").error


def test_offsets_are_bytes():
    source = "package p\n\n// é—\nfunc É() {}\n".encode()
    (f,) = scan(source).decls
    assert f.exported and f.name == "É" and source[f.node_start : f.node_end].decode() == "func É() {}"


def test_comment_text_keeps_paragraphs():
    (f,) = decls("/*\nOne.\n\n\nTwo.\n*/\nfunc F() {}")
    assert f.doc == "One.\n\nTwo.\n" and comment_text(None) == ""
