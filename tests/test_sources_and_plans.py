"""The tree source, globs, strict plans, overlays and text renderings."""

from __future__ import annotations

import pytest

from canopy import fixtures
from canopy.functions import gotext as g
from canopy.functions.edit_rules import Action, Tree
from canopy.functions.globs import glob_match
from canopy.functions.goformat import formatted
from canopy.functions.gotypes import type_string
from canopy.operators import edits, interfaces, render, symbols
from canopy.operators.graph import GraphOptions, graph
from canopy.plans import schemas
from canopy.plans.corpus import Corpus
from canopy.plans.plan_file import plan_frame, read_plan
from canopy.sources.gotree import write_tree


@pytest.fixture
def root(tmp_path):
    for path, text in fixtures.SHOP.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "_under.go").write_text("package x\n")
    (tmp_path / ".dot.go").write_text("package x\n")
    (tmp_path / "readme.md").write_text("no")
    return tmp_path


def test_source_lists_what_a_walk_visits(spark, root):
    corpus = Corpus.of_roots(spark, {"r": str(root)}, batch="2")
    paths = {r["path"] for r in corpus.files.collect()}
    assert {"_under.go", ".dot.go", "_draft/draft.go", "go.mod", "pkg/domain/store/store.go"} <= paths
    assert not any(p.startswith((".cache", "vendor")) or p.endswith(".md") for p in paths)
    listed = [r["path"] for r in graph(corpus, GraphOptions(depth=2)).orderBy("ord").collect()]
    assert listed == [".", "_draft", "broken", "pkg/app", "pkg/domain"]


def test_source_options_prune_while_walking(spark, root):
    corpus = Corpus.of_roots(spark, {"r": str(root)}, depth="2", exclude="a*,b*", tests="false")
    assert {r["dir"] for r in corpus.go_files.select("dir").distinct().collect()} == {".", "_draft", "pkg/domain"}
    assert Corpus.of_roots(spark, {"r": str(root / "pkg/app")}, recursive="false").go_files.count() == 2
    with pytest.raises(Exception, match="No such file"):
        Corpus.of_roots(spark, {"r": str(root / "none")}).files.count()
    assert Corpus.of_roots(spark, {"r": str(root / "none")}, errors="skip").files.count() == 0


def test_globs():
    assert glob_match("d*", "domain") and glob_match("?b", "ab") and glob_match("[a-c]x", "bx") and glob_match(r"\*", "*") and glob_match("[^a]", "b")
    assert not any(glob_match(p, "a") for p in ("[", "[]", "[a", "a\\", "[z-a]", "b", ""))


def test_plan_is_strict():
    plan = read_plan("actions:\n- action: add_func\n  file: a.go\n  content: 'func F() {}'\n  strip_doc: true\n")
    assert plan == [Action("add_func", "a.go", content="func F() {}", strip_doc=True)]
    assert read_plan("") == []
    for bad in ("actions: []\nmore: 1", "actions:\n- action: x\n  colour: red", "- a", "actions:\n- action: 3", "a: ["):
        with pytest.raises(g.EngineError, match="PARSE_ERROR"):
            read_plan(bad)


def test_plan_runs_in_order_and_stops_at_the_first_failure(spark):
    corpus = Corpus.of_texts(spark, {"a": fixtures.EDITS, "b": fixtures.EDITS})
    text = "actions:\n- {action: add_func, file: a.go, content: 'func New() {}'}\n- {action: delete_func, file: a.go, identifier: New}\n- {action: delete_func, file: a.go, identifier: New}\n- {action: create_file, file: z.go, content: 'x'}\n"
    changed, outcomes = edits.execute_plan(corpus, plan_frame(corpus, text))
    rows = outcomes.orderBy("repo").collect()
    assert [(r["repo"], r["files_modified"], r["failed_seq"], r["error_code"]) for r in rows] == [(x, 1, 2, "NODE_NOT_FOUND") for x in "ab"]
    assert {r["path"] for r in changed.collect()} == {"a.go"}
    assert edits.total_modified([outcomes, outcomes]).first()["files_modified"] == 4
    assert "Hint:" in render.outcome_text(outcomes)
    with pytest.raises(g.EmptyPlan):
        edits.execute_plan(corpus, plan_frame(corpus, "actions: []"))


def test_overlay_reads_changes_and_leaves_the_base_alone(spark, tmp_path):
    corpus = Corpus.of_texts(spark, {"a": fixtures.EDITS})
    changed, _ = edits.run_action(corpus, Action("add_func", "new/n.go", package="n", content="func N() {}"), "a")
    after = edits.overlay(corpus, changed)
    assert symbols.find_symbols(after, symbols.SymbolQuery("N")).count() == 1
    assert symbols.find_symbols(corpus, symbols.SymbolQuery("N")).count() == 0
    write_tree(changed, str(tmp_path))
    assert (tmp_path / "new/n.go").read_text() == "package n\n\nfunc N() {}\n"


def test_identifiers_and_names():
    assert g.parse_identifier("(*T).M") == ("T", "M") and g.parse_identifier("p.(*T).M") == ("T", "M")
    assert g.parse_identifier("F") == ("", "F") and g.parse_identifier("a.b.c.d") == ("a", "b")
    assert [g.snake_name(x) for x in ("FirstName", "UserID", "HTTPServer")] == ["first_name", "user_id", "http_server"]
    assert [g.camel_name(x) for x in ("ID", "FirstName", "URLPath")] == ["id", "firstName", "uRLPath"]
    assert g.merged_tag('a:"1"', 'a:"2"') == 'a:"1"' and g.merged_tag('a:""', 'a:"2"') == 'a:"" a:"2"' and g.merged_tag("", 'b:"2"') == 'b:"2"'
    assert g.first_identifier("func (s *S) M() {}") == "S.M" and g.first_identifier("type T int") == "T" and g.first_identifier("x") == "content"
    assert g.first_quoted('a "b" c') == "b" and g.first_type_name("// x\ntype T int") == "T" and g.first_type_name("x") == "interface"


def test_documentation_rules():
    tree = lambda: Tree({"a.go": fixtures.EDITS["a.go"].encode()})

    def after(**options) -> str:
        t = tree()
        t.apply(Action("update_func", "a.go", identifier="T.M", content="func (t *T) M() {}", **options))
        return t.files["a.go"].decode()

    assert "// M does it.\nfunc (t *T) M() {}" in after()
    assert "// M does it" not in after(strip_doc=True)
    assert "// New words.\nfunc (t *T) M() {}" in after(doc="New words.") and "does it" not in after(doc="New words.")


def test_interface_actions_and_messages():
    t = Tree({"p/a.go": b"package p\n\ntype R interface {\n\tOld()\n}\n"})
    _, said = t.apply(Action("update_interface", "p/a.go", identifier="R", content="type R interface {\n\tNew() int\n}", mock_file="mocks/r.go", mock_name="MockR"))
    assert said == "SUCCESS: Updated R in a.go, regenerated Generated MockR (1 methods) in mocks/r.go"
    assert b"NewFunc func() int" in t.files["mocks/r.go"] and b"var _ p.R" in t.files["mocks/r.go"]
    assert t.apply(Action("delete_interface", "p/a.go", identifier="R"))[1] == "SUCCESS: Deleted R from a.go"
    with pytest.raises(g.EngineError, match="no interface type declaration"):
        g.mock_from_source("type T struct{}", "M", "p", "p")
    with pytest.raises(g.EngineError, match="invalid action type"):
        t.apply(Action("dance", "a.go"))


def test_conflicting_signature_is_an_error(spark):
    corpus = Corpus.of_texts(spark, {"x": {"a.go": "package a\n\ntype T int\n\nfunc (t T) Now(x int) {}\n"}})
    catalog = spark.createDataFrame([("clock", "Clock", 0, "Now", [], [("", "int", False)])], schemas.CATALOG)
    with pytest.raises(g.EngineError, match="Expected 0 params and 1 results, got 1 params and 0 results"):
        interfaces.implement(corpus, "clock.Clock", "T", "a.go", catalog)
    with pytest.raises(g.EngineError, match="not found"):
        interfaces.implement(corpus, "clock.None", "T", "a.go", catalog)
    with pytest.raises(g.EngineError, match="not an interface"):
        interfaces.resolve(corpus, catalog, "a.T")


def test_embedded_interfaces_close_over_packages(spark):
    tree = {"a/a.go": "package a\n\ntype A interface {\n\tb.B\n\tX(t Own)\n}\n\ntype Own int\n", "b/b.go": "package b\n\ntype B interface {\n\tC\n\tY() *T\n}\n\ntype C interface{ Z() }\n\ntype T int\n"}
    _, _, methods = interfaces.resolve(Corpus.of_texts(spark, {"x": tree}), None, "a.A")
    assert [(m.name, m.tuple_type(), m.results_type()) for m in methods] == [("X", "(t a.Own)", ""), ("Y", "()", "*b.T"), ("Z", "()", "")]


def test_types_are_printed_as_a_checker_does():
    show = lambda source: type_string(source, "d", {"Own", "List"}, {"st": "store"})
    for source, want in {
        "Own": "d.Own", "*Own": "*d.Own", "[]Own": "[]d.Own", "[4]Own": "[4]d.Own", "map[Own]st.T": "map[d.Own]store.T", "chan<- Own": "chan<- d.Own", "<-chan Own": "<-chan d.Own",
        "chan (<-chan Own)": "chan (<-chan d.Own)", "func(Own Own) Own": "func(Own d.Own) d.Own", "func(a, b Own, c ...st.T) (Own, error)": "func(a d.Own, b d.Own, c ...store.T) (d.Own, error)",
        "func() (err error)": "func() (err error)", "struct { Own; A, B Own `j:\"x\"` }": 'struct{d.Own; A d.Own "j:\\"x\\""; B d.Own "j:\\"x\\""}', "interface { M(Own Own); Own }": "interface{M(Own d.Own); d.Own}",
        "List[Own, st.T]": "d.List[d.Own,store.T]", "( Own )": "d.Own", "int": "int", "interface{}": "interface{}", "not a type ]": "not a type ]",
    }.items():
        assert show(source) == want, source


def test_layout_of_written_source():
    source = (
        'package a\n\n\n\nimport (\n\t"testing"\n\t"github.com/x/assert"\n\tfoo "github.com/x/aaa"\n\t"context"\n)\n\n\ntype T struct {\n\tA int\n\tLong, B map[string]int `json:"x"`\n\tC string  `y:"z"`\n\n\tD   func() (int, error)\n'
        "\tEmbedded\n\tE  int // note\n}\n\nfunc (m *T) Close()  {   \n\ts := `raw   \n\n\n x`\n\t// c\n\treturn\n}\n\n\n"
    )
    want = (
        'package a\n\nimport (\n\t"context"\n\t"testing"\n\n\tfoo "github.com/x/aaa"\n\t"github.com/x/assert"\n)\n\ntype T struct {\n\tA       int\n\tLong, B map[string]int `json:"x"`\n\tC       string         `y:"z"`\n\n\tD func() (int, error)\n'
        "\tEmbedded\n\tE  int // note\n}\n\nfunc (m *T) Close() {\n\ts := `raw   \n\n\n x`\n\t// c\n\treturn\n}\n"
    )
    assert formatted(source.encode()).decode() == want and formatted(want.encode()).decode() == want
    for same in ("package a\n\nimport (\n\t// b\n\t\"b\"\n\t\"a\"\n)\n", "package a\n\nfunc (\n", "no go   \n\n\n"):
        assert formatted(same.encode()).decode() == same
    for text in fixtures.SHOP.values():
        assert formatted(formatted(text.encode())) == formatted(text.encode())


def test_trees_and_packages_that_share_names_stay_apart(spark):
    trees = {
        "x": {"go.mod": "module m/x\n", "d/d.go": "package d\n\ntype Store interface{ Save() }\n", "e/d/d.go": "package d\n\ntype Store interface{ Other() }\n", "t/t.go": "package t\n\ntype T int\n"},
        "y": {"d/d.go": "package d\n\ntype Store interface{ Drop() }\n", "t/t.go": "package t\n\ntype T int\n"},
    }
    corpus = Corpus.of_texts(spark, trees)
    names = lambda name, repo: [m.name for m in interfaces.resolve(corpus, None, name, repo)[2]]
    assert names("m/x/d.Store", "x") == ["Save"] and names("m/x/e/d.Store", "x") == ["Other"] and names("d.Store", "y") == ["Drop"]
    with pytest.raises(g.EngineError, match="several packages"):
        interfaces.resolve(corpus, None, "d.Store", "x")
    with pytest.raises(ValueError, match="several trees"):
        interfaces.resolve(corpus, None, "d.Store")
    changed, found = interfaces.implement(corpus, "d.Store", "*T", "t/t.go", repo="y")
    assert [(r["repo"], r["path"]) for r in changed.collect()] == [("y", "t/t.go")] and [r["name"] for r in found.collect()] == ["Drop"]
    assert {r["home"] for r in interfaces.package_homes(corpus).collect()} == {"m/x/d", "m/x/e/d", "m/x/t", "d", "t"}


def test_diamonds_give_each_method_once_and_circles_are_errors(spark):
    tree = {"a/a.go": "package a\n\ntype A interface {\n\tB\n\tC\n}\n\ntype B interface{ D }\n\ntype C interface{ D }\n\ntype D interface{ Do() }\n"}
    assert [m.name for m in interfaces.resolve(Corpus.of_texts(spark, {"x": tree}), None, "a.A")[2]] == ["Do"]
    tree = {"a/a.go": "package a\n\ntype A interface{ B }\n\ntype B interface{ A }\n"}
    with pytest.raises(g.EngineError, match="embeds itself"):
        interfaces.resolve(Corpus.of_texts(spark, {"x": tree}), None, "a.A")


def test_graph_options_reach_the_source(spark, root):
    corpus = Corpus.of_roots(spark, {"r": str(root)})
    o = GraphOptions(dir="pkg", deps=True, summary=True, exclude=("d*",))
    assert [(r["path"], r["deps"]) for r in graph(corpus, o).collect()] == [("pkg/app", ["pkg/domain", "pkg/domain/store"])]
    read = corpus.narrowed(dir="pkg", exclude="d*", tests="false").files
    assert {r["path"] for r in read.collect()} == {"go.mod", "pkg/app/doc.go", "pkg/app/service.go"}
    assert corpus.cache().narrowed(dir="pkg") is corpus
    for o in (GraphOptions(symbols=True, recursive=True, summary=True, deps=True), GraphOptions(dir="pkg/domain", symbols=True, tests=True), GraphOptions(depth=2, exclude=("[_b]*",))):
        assert graph(Corpus.of_roots(spark, {"r": str(root)}), o).collect() == graph(corpus, o).collect()


def test_one_scan_of_the_files_a_graph(spark):
    corpus = Corpus.of_texts(spark, {"shop": fixtures.SHOP})
    plan = graph(corpus, GraphOptions(symbols=True, recursive=True, summary=True, deps=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_renderings(spark):
    corpus = Corpus.of_texts(spark, {"shop": fixtures.SHOP})
    o = GraphOptions(dir="pkg/domain", summary=True, deps=True)
    assert render.graph_text(graph(corpus, o), o) == "pkg/domain → (none)\npkg/domain/store → pkg/domain\n"
    o = GraphOptions(focus="pkg/domain/store").implied()
    text = render.graph_text(graph(corpus, o), GraphOptions(focus="pkg/domain/store"), style="tool")
    assert "pkg/app\n\npkg/domain\n\npkg/domain/store — keeps orders" not in text and "  type Closer interface { Close }" in text
    empty = GraphOptions(dir="nowhere")
    assert render.graph_text(graph(corpus, empty), empty) == "No Go packages found in 'nowhere'.\nHint: check that you're in the project root, or use '--dir <path>' to target a subdirectory.\n"
    one = render.symbol_text(symbols.resolve(corpus, "NewOrder"), "NewOrder", body=True)
    assert one.startswith("Symbol: NewOrder\nFile: pkg/domain/order.go:15-17 (3 lines body)\nDoc:\nNewOrder makes an empty order.\n")
    many = Corpus.of_texts(spark, {"m": {"a.go": "package a\nfunc F() {}\n", "b/b.go": "package b\ntype F int\n"}})
    assert "Matches (Functions):\n- F in a.go:2\n" in render.symbol_text(symbols.resolve(many, "F"), "F")
    assert "No symbols" in render.symbol_text(symbols.resolve(corpus, "a.b.c.d"), "a.b.c.d")
    assert "Customer" in render.report_text(symbols.file_report(corpus, "pkg/domain/customer.go"))


def test_budget_levels_match_a_sequential_loop(spark):
    rows = [("r", f"p{i}", [{"path": f"p{i}/f.go", "symbols": ["x" * (7 * i % 13)]}], "s" * (i % 5), [f"d{i}"]) for i in range(9)]
    schema = "repo string, path string, files array<struct<path:string,symbols:array<string>>>, summary string, deps array<string>"
    frame = spark.createDataFrame(rows, schema)
    from canopy.operators.graph import within_budget

    def cost(packages):
        return sum(len(p) + len(s) + sum(len(x) + 2 for x in d or []) + sum(len(f["path"]) + sum(map(len, f["symbols"] or [])) for f in fs or []) for _, p, fs, s, d in packages) // 4

    for budget in (1, 3, 6, 12, 25, 33, 40, 60, 100):
        want = list(rows)
        steps = (lambda r: (r[0], r[1], r[2], "", r[4]), lambda r: (r[0], r[1], r[2], "", None), lambda r: (r[0], r[1], [{"path": f["path"], "symbols": None} for f in r[2]], "", None), lambda r: (r[0], r[1], None, "", None))
        for step in steps:
            if cost(want) > budget:
                want = [step(r) for r in want]
        while len(want) > 1 and cost(want) > budget:
            want.pop()
        got = [(r["repo"], r["path"], None if r["files"] is None else [f.asDict() for f in r["files"]], r["summary"], r["deps"]) for r in within_budget(frame, budget).orderBy("path").collect()]
        assert got == want, budget


def test_verbs_and_modes(spark, tmp_path):
    corpus = Corpus.of_texts(spark, {"a": fixtures.EDITS})
    changed, outcome = edits.create(corpus, "struct", "a.go", "type U struct{}", repo="a")
    assert outcome.first()["files_modified"] == 1
    after = edits.settle(corpus, changed)
    updated, _ = edits.update(after, "struct", "a.go", "type U struct{ X int }", "U", doc="U is new.", repo="a")
    assert symbols.find_symbols(edits.settle(after, updated), symbols.SymbolQuery("U")).first()["doc"] == "U is new."
    gone, _ = edits.delete(after, "func", "a.go", "T.M", repo="a")
    assert "-func (t *T) M() {" in edits.settle(after, gone, "diff").first()["diff"]
    edits.settle(corpus, changed, "write", str(tmp_path))
    assert (tmp_path / "a.go").read_text().endswith("\ntype U struct{}\n")
    for bad in (lambda: edits.delete(corpus, "file", "a.go", "x"), lambda: edits.settle(corpus, changed, "dance")):
        with pytest.raises(g.EngineError, match="INVALID_ACTION"):
            bad()
