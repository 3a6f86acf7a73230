"""Golden queries: the engine on fixture trees, against rows that were worked out by hand from the rules.

Lists are joined to strings, so that values compare alike in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import fixtures
from canopy.functions import columns, gotext
from canopy.functions.edit_rules import Action
from canopy.functions.gotext import EngineError
from canopy.operators import edits, interfaces, render, symbols
from canopy.operators.graph import GraphOptions, graph, sub_packages
from canopy.plans import schemas
from canopy.plans.corpus import Corpus
from canopy.plans.lineage import ensure_checkpoint_dir
from canopy.plans.plan_file import plan_frame
from canopy.sources.gotree import write_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return f"CAST({value} AS INTEGER)"
    return "'" + value.replace("'", "''") + "'"


def _golden(name: str, names: list[str], expected: list[tuple]):
    def register(make: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        QUERIES[f"golden_{name}"] = lambda spark, _: make(spark).select(*names)
        rows = ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in expected)
        ORACLE[f"golden_{name}"] = f"SELECT * FROM (VALUES {rows}) t({', '.join(names)})"
        return make

    return register


def _shop(spark: SparkSession) -> Corpus:
    return Corpus.of_texts(spark, {"shop": fixtures.SHOP})


def _edits(spark: SparkSession) -> Corpus:
    return Corpus.of_texts(spark, {"a": fixtures.EDITS})


def _map(spark: SparkSession, **options) -> DataFrame:
    rows = graph(_shop(spark), GraphOptions(**options))
    listed = F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(": "), F.coalesce(F.array_join(f["symbols"], " | "), F.lit("-")))), "\n")
    return rows.select(F.col("ord").alias("n"), "path", "summary", F.array_join("deps", ",").alias("deps"), listed.alias("files"))


def _text(changed: DataFrame) -> DataFrame:
    return changed.select("path", F.decode("content", "UTF-8").alias("content"))


ALL = ["_draft", "broken", "pkg/app", "pkg/domain", "pkg/domain/store"]


@_golden("scan", ["n", "path"], [(i + 1, p) for i, p in enumerate(ALL)])
def _scan(spark):
    return _map(spark)


@_golden("depth", ["path"], [(p,) for p in ALL[:4]])
def _depth(spark):
    return _map(spark, depth=2)


@_golden("exclude", ["path"], [("pkg/domain",), ("pkg/domain/store",)])
def _exclude(spark):
    return _map(spark, exclude=("[_b]*", "a??", "[z-a]"))


SHOP_APP = "type Service struct {\n    Store st.Store\n    Name string\n    Port int\n    Hosts []string\n    Limits map[string]int\n    last *domain.Order\n}"
SHOP_SERVICE = f"pkg/app/service.go: {SHOP_APP} | func (s *Service) Run(n int, hosts ...string) error | func (s *Service) Stop()"
SHOP_CUSTOMER = "pkg/domain/customer.go: type Customer struct {} | func (c Customer) Name() string | type Visitor Customer"
SHOP_ORDER = "pkg/domain/order.go: type OrderID string | type Order struct { ID OrderID; Total int; notes []string } | func NewOrder(id OrderID) *Order"
SHOP_STORE = "pkg/domain/store/store.go: type Store interface { Save; Load; Closer } | type Closer interface { Close }"
SHOP_TEST = "pkg/domain/order_test.go: type fake struct { Order } | func helper() int"


@_golden("symbols", ["path", "files"], [("pkg/domain", f"{SHOP_CUSTOMER}\n{SHOP_ORDER}")])
def _symbols(spark):
    return _map(spark, dir="pkg/domain", symbols=True)


@_golden("symbols_tests", ["path", "files"], [("pkg/domain", f"{SHOP_CUSTOMER}\n{SHOP_ORDER}\n{SHOP_TEST}")])
def _symbols_tests(spark):
    return _map(spark, dir="pkg/domain", symbols=True, tests=True)


@_golden(
    "symbols_recursive",
    ["path", "files"],
    [
        ("_draft", "_draft/draft.go: func Draft()"),
        ("broken", "broken/broken.go: WARNING: failed to parse: broken/broken.go:4:1: expected ')', found end of file"),
        ("pkg/app", SHOP_SERVICE),
        ("pkg/domain", f"{SHOP_CUSTOMER}\n{SHOP_ORDER}"),
        ("pkg/domain/store", SHOP_STORE),
    ],
)
def _symbols_recursive(spark):
    return _map(spark, symbols=True, recursive=True)


@_golden("summary", ["path", "summary"], list(zip(ALL, ["", "", "", "", ""], strict=True)))
def _summary_first_file(spark):
    return _map(spark, summary=True)


@_golden("summary_order", ["path", "summary"], [("pkg/domain", "holds the records of the shop.")])
def _summary(spark):
    files = {k: v for k, v in fixtures.SHOP.items() if k == "pkg/domain/order.go"}
    return graph(Corpus.of_texts(spark, {"shop": files}), GraphOptions(summary=True))


@_golden("deps", ["path", "deps"], list(zip(ALL, [None, None, "pkg/domain,pkg/domain/store", None, "pkg/domain"], strict=True)))
def _deps(spark):
    return _map(spark, deps=True)


@_golden(
    "focus",
    ["path", "files"],
    [("_draft", None), ("broken", None), ("pkg/app", None), ("pkg/domain", f"{SHOP_CUSTOMER}\n{SHOP_ORDER}"), ("pkg/domain/store", SHOP_STORE)],
)
def _focus(spark):
    return graph_focus(spark)


def graph_focus(spark: SparkSession) -> DataFrame:
    from dataclasses import asdict

    return _map(spark, **asdict(GraphOptions(focus="pkg/domain").implied()))


#: Bytes of the paths: 6 + 6 + 7 + 10 + 16 = 45; of the dependencies: 10 + 2 + 16 + 2 + 10 + 2 = 42.
@_golden("budget_deps", ["path", "deps"], [(p, None) for p in ALL])
def _budget_deps(spark):
    return _map(spark, deps=True, token_budget=12)


@_golden("budget_tail", ["path"], [("_draft",), ("broken",), ("pkg/app",)])
def _budget_tail(spark):
    return _map(spark, deps=True, token_budget=4)  # (6 + 6 + 7) // 4 = 4, with the next path 7


@_golden("budget_files", ["path", "files"], [("pkg/domain", "pkg/domain/customer.go: -\npkg/domain/order.go: -")])
def _budget_files(spark):
    return _map(spark, dir="pkg/domain", symbols=True, token_budget=13)  # (10 + 22 + 19) // 4 = 12


SYMBOL = ["file", "line_start", "line_end", "name", "receiver", "signature", "doc", "code"]


@_golden(
    "find_method",
    SYMBOL,
    [("pkg/app/service.go", 22, 27, "Run", "Service", "func (s *Service) Run(n int, hosts ...string) error", "", "22: func (s *Service) Run(n int, hosts ...string) error {\n23: \tfmt.Println(n, hosts)\n26: \treturn nil\n27: }")],
)
def _find_method(spark):
    return symbols.find_symbols(_shop(spark), symbols.SymbolQuery("Run", receiver="Service"))


@_golden(
    "find_type",
    SYMBOL,
    [("pkg/domain/order.go", 4, 5, "OrderID", "", "OrderID string", "OrderID names an order.", "4: // OrderID names an order.\n5: type OrderID string")],
)
def _find_type(spark):
    return symbols.find_symbols(_shop(spark), symbols.SymbolQuery("OrderID"))


@_golden("resolve", ["file", "name", "receiver", "bucket"], [("pkg/domain/customer.go", "Name", "Customer", "methods")])
def _resolve(spark):
    return symbols.bucketed(symbols.resolve(_shop(spark), "Customer.Name"))


@_golden("resolve_twice", ["file", "name"], [("domain.go", "Get"), ("domain.go", "Get")])
def _resolve_twice(spark):
    tree = {"domain.go": "package domain\n\ntype domain struct{}\n\nfunc (d domain) Get() {}\n"}
    return symbols.resolve(Corpus.of_texts(spark, {"x": tree}), "domain.Get")


@_golden("sub_packages", ["name"], [("app",), ("domain",)])
def _sub_packages(spark):
    return sub_packages(_shop(spark), "pkg")


@_golden("file_report", ["line_start", "name", "receiver"], [(3, "Customer", ""), (6, "Name", "Customer"), (8, "Visitor", "")])
def _file_report(spark):
    return symbols.file_report(_shop(spark), "pkg/domain/customer.go")


@_golden("module_header", ["n", "path"], [(0, "# Module: example.test/domain @ v1.2.0\n# Location: pkg/domain"), (1, "."), (2, "store")])
def _module(spark):
    modules = spark.createDataFrame([("example.test/domain", "v1.2.0", "pkg/domain", "shop")], schemas.MODULES)
    return graph(Corpus.of_texts(spark, {"shop": fixtures.SHOP}, modules), GraphOptions(module="example.test/domain")).withColumnRenamed("ord", "n")


def _run(spark: SparkSession, *actions: Action) -> tuple[DataFrame, DataFrame]:
    corpus = _edits(spark)
    return edits.execute_plan(corpus, edits.actions_frame(corpus, list(actions), "a"))


OUTCOME = ["files_modified", "warnings", "failed_seq", "error_code", "error_message"]


def _outcome(rows: DataFrame) -> DataFrame:
    return rows.select("files_modified", F.array_join("warnings", "\n").alias("warnings"), "failed_seq", "error_code", "error_message")




@_golden(
    "update_func",
    ["path", "content"],
    [("a.go", fixtures.EDITS["a.go"].replace("func (t *T) M() {\n\tprintln(1)\n}", "func (t *T) M() int { return 2 }").replace("func Free() {}", "// Free is new.\n//\n// Really.\nfunc Free() { }"))],
)
def _update_func(spark):
    changed, _ = _run(spark, Action("update_func", "a.go", identifier="(*T).M", content="func (t *T) M() int { return 2 }"), Action("update_func", "a.go", identifier="a.Free", content="func Free() { }", doc="Free is new.\n\nReally."))
    return _text(changed)


@_golden("update_fallback", OUTCOME, [(1, 'update_func: identifier "Gone" not found in a.go, treated as add_func', None, "", "")])
def _update_fallback(spark):
    return _outcome(_run(spark, Action("update_func", "a.go", identifier="Gone", content="func Gone() {}"))[1])


@_golden(
    "add_duplicate",
    OUTCOME,
    [(1, "", 1, "NODE_ALREADY_EXISTS", 'function "T.M" already declared in a.go:\n\n// M does it.\nfunc (t *T) M() {\n\tprintln(1)\n}')],
)
def _add_duplicate(spark):
    return _outcome(_run(spark, Action("add_func", "a.go", content="func Fresh() {}"), Action("add_func", "a.go", content="func (x T) M() {}"))[1])


@_golden("delete_struct", ["path", "content"], [("a.go", "package a\n\n\n\n\n\nfunc Free() {}\n")])
def _delete_struct(spark):
    return _text(_run(spark, Action("delete_struct", "a.go", identifier="T"))[0])


@_golden("update_grouped", ["path", "content"], [("group.go", "package a\n\ntype (\n\t// One is first.\n\tOne struct{}\n\ttype Two string\n)\n")])
def _update_grouped(spark):
    return _text(_run(spark, Action("update_struct", "group.go", identifier="Two", content="type Two string"))[0])


@_golden("create_file", ["path", "content"], [("b.go", "package a\n\nfunc B() {}\n")])
def _create(spark):
    return _text(_run(spark, Action("create_file", "b.go", content="func B() {}\n"))[0])


@_golden("missing_file", OUTCOME, [(0, "", 0, "FILE_NOT_FOUND", "file not found")])
def _missing(spark):
    return _outcome(_run(spark, Action("replace_file", "c.go", content="x"))[1])


@_golden("delete_missing", OUTCOME, [(0, "", 0, "NODE_NOT_FOUND", "node not found")])
def _delete_missing(spark):
    return _outcome(_run(spark, Action("delete_func", "a.go", identifier="Nope"))[1])


@_golden(
    "tag_json",
    ["path", "content"],
    [("a.go", fixtures.EDITS["a.go"].replace("ID        int", 'ID        int `json:"id"`').replace('`xml:"n"`', '`xml:"n" json:"firstName"`').replace("HTTPPort  int", 'HTTPPort  int `json:"hTTPPort"`'))],
)
def _tag_json(spark):
    return _text(edits.tag_struct(_edits(spark), "a.go", "T", auto="json")[0])


@_golden(
    "tag_bson",
    ["path", "content"],
    [("a.go", fixtures.EDITS["a.go"].replace("ID        int", 'ID        int `bson:"id"`').replace('`xml:"n"`', '`xml:"n" bson:"first_name"`').replace("HTTPPort  int", 'HTTPPort  int `bson:"http_port"`'))],
)
def _tag_bson(spark):
    return _text(edits.tag_struct(_edits(spark), "a.go", "T", auto="bson")[0])


@_golden(
    "mock_source",
    ["path", "content"],
    [
        (
            "mocks/reader.go",
            "package mocks\n\ntype MockReader struct {\n\tReadFunc func(p []byte) (n int, err error)\n\tSkipFunc func(p0 int, p1 string) \n\tLogFunc func(format string, args ...any) \n}\n"
            '\nfunc (m *MockReader) Read(p []byte) (n int, err error) {\n\tif m.ReadFunc == nil {\n\t\tpanic("MockReader.ReadFunc not set")\n\t}\n\treturn m.ReadFunc(p)\n}\n'
            '\nfunc (m *MockReader) Skip(p0 int, p1 string)  {\n\tif m.SkipFunc == nil {\n\t\tpanic("MockReader.SkipFunc not set")\n\t}\n\tm.SkipFunc(p0, p1)\n}\n'
            '\nfunc (m *MockReader) Log(format string, args ...any)  {\n\tif m.LogFunc == nil {\n\t\tpanic("MockReader.LogFunc not set")\n\t}\n\tm.LogFunc(format, args...)\n}\n'
            "\nvar _ a.Reader = (*MockReader)(nil)\n",
        )
    ],
)
def _mock_source(spark):
    changed, _ = edits.add_interface(_edits(spark), "a.go", fixtures.READER, "mocks/reader.go", "MockReader", repo="a")
    return _text(changed).where("path like 'mocks/%'")


@_golden(
    "mock_typed",
    ["path", "content"],
    [
        (
            "pkg/app/fake.go",
            "package app\n\ntype Fake struct {\n\tCloseFunc func()\n\tLoadFunc func(ctx context.Context, id domain.OrderID) (*domain.Order, error)\n\tSaveFunc func(ctx context.Context, o *domain.Order) error\n}\n"
            '\nfunc (m *Fake) Close()  {\n\tif m.CloseFunc == nil {\n\t\tpanic("Fake.CloseFunc not set")\n\t}\n\tm.CloseFunc()\n}\n'
            '\nfunc (m *Fake) Load(ctx context.Context, id domain.OrderID) (*domain.Order, error) {\n\tif m.LoadFunc == nil {\n\t\tpanic("Fake.LoadFunc not set")\n\t}\n\treturn m.LoadFunc(ctx, id)\n}\n'
            '\nfunc (m *Fake) Save(ctx context.Context, o *domain.Order) error {\n\tif m.SaveFunc == nil {\n\t\tpanic("Fake.SaveFunc not set")\n\t}\n\treturn m.SaveFunc(ctx, o)\n}\n'
            "\nvar _ store.Store = (*Fake)(nil)\n",
        )
    ],
)
def _mock_typed(spark):
    return _text(interfaces.mock(_shop(spark), "store.Store", "*Fake", "pkg/app/fake.go")[0])


CLOCK = [("example.test/clock", "Clock", 0, "Now", [], [("", "int", False)]), ("example.test/clock", "Clock", 1, "Sleep", [("d", "int", False), ("more", "string", True)], [])]


@_golden(
    "implement",
    ["file", "name", "receiver", "signature", "doc"],
    [
        ("pkg/domain/customer.go", "Now", "Customer", "func (r *Customer) Now() int", "Now implements clock.Clock."),
        ("pkg/domain/customer.go", "Sleep", "Customer", "func (r *Customer) Sleep(d int, more []string)", "Sleep implements clock.Clock."),
    ],
)
def _implement(spark):
    catalog = spark.createDataFrame(CLOCK, schemas.CATALOG)
    return interfaces.implement(_shop(spark), "clock.Clock", "*Customer", "pkg/domain/customer.go", catalog)[1]


@_golden("implement_done", ["file"], [])
def _implement_done(spark):
    catalog = spark.createDataFrame([("x", "Namer", 0, "Name", [], [("", "string", False)])], schemas.CATALOG)
    return interfaces.implement(_shop(spark), "x.Namer", "Customer", "pkg/domain/customer.go", catalog)[1]


ORACLE["golden_implement_done"] = "SELECT CAST(NULL AS VARCHAR) AS file WHERE false"


@_golden("extract_interface", ["path", "content"], [("pkg/app/service.go", fixtures.SHOP["pkg/app/service.go"] + "\ntype Runner interface {\n\tRun(n int, hosts ...string) error\n\tStop()\n}\n")])
def _extract(spark):
    return _text(edits.extract_interface(_shop(spark), "pkg/app/service.go", "Service", "Runner", repo="shop")[0])


@_golden(
    "test_skeleton",
    ["path", "content"],
    [
        (
            "pkg/app/service_test.go",
            'package app_test\n\nimport (\n\t"testing"\n\t"github.com/stretchr/testify/assert"\n\t"github.com/stretchr/testify/require"\n)\n\n\n'
            "func TestService_Run(t *testing.T) {\n\ttype args struct {\n\t\tn int\n\t\thosts ...string\n\t}\n\ttests := []struct {\n\t\tname string\n\t\ts *Service\n\t\targs args\n\t\twantErr bool\n\t}{\n"
            '\t\t// TODO: Add test cases.\n\t}\n\tif len(tests) == 0 {\n\t\tt.Skip("TODO: no test cases defined for TestService_Run")\n\t}\n\tfor _, tt := range tests {\n\t\tt.Run(tt.name, func(t *testing.T) {\n'
            "\t\t\terr := tt.s.Run(tt.args.n, tt.args.hosts)\n\t\t\tif tt.wantErr {\n\t\t\t\tassert.Error(t, err)\n\t\t\t\treturn\n\t\t\t}\n\t\t\trequire.NoError(t, err)\n\t\t})\n\t}\n}\n",
        )
    ],
)
def _test_skeleton(spark):
    return _text(edits.generate_test(_shop(spark), "pkg/app/service.go", "Service.Run", repo="shop")[0])


@_golden(
    "diff",
    ["path", "diff"],
    [("group.go", "--- a/group.go\n+++ b/group.go\n@@ -3,5 +3,5 @@\n type (\n \t// One is first.\n \tOne struct{}\n-\tTwo int\n+\ttype Two string\n )\n")],
)
def _diff(spark):
    corpus = _edits(spark)
    changed, _ = edits.execute_plan(corpus, edits.actions_frame(corpus, [Action("update_struct", "group.go", identifier="Two", content="type Two string")], "a"))
    return edits.unified_diff(corpus, changed)


@_golden("unresolved_selectors", ["name"], [("os",)])
def _unresolved(spark):
    tree = {"a.go": 'package a\n\nimport "fmt"\n\ntype T struct{}\n\nfunc (t T) F(x T) { fmt.Println(x.Y, t.Z, os.Args); v := x; v.Do() }\n'}
    return interfaces.unresolved_selectors(Corpus.of_texts(spark, {"x": tree}), "a.go")


# -- interfaces of several trees, and signatures as a type checker prints them -------------------------------
BODY = '{\n\t// TODO: implement NAME\n\tpanic("not implemented")\n}\n'


def _trees(spark: SparkSession) -> Corpus:
    return Corpus.of_texts(spark, {"x": fixtures.TREE_X, "y": fixtures.TREE_Y})


@_golden("implement_two_trees", ["repo", "path", "content"], [("y", "t/t.go", fixtures.TREE_Y["t/t.go"] + "\n// Drop implements d.Store.\nfunc (r *T) Drop(n int, m int) (a int, b int) " + BODY.replace("NAME", "Drop"))])
def _implement_two_trees(spark):
    return interfaces.implement(_trees(spark), "d.Store", "*T", "t/t.go", repo="y")[0].withColumn("content", F.decode("content", "UTF-8"))


@_golden(
    "implement_file",
    ["path", "content"],
    [
        (
            "t/t.go",
            fixtures.TREE_X["t/t.go"]
            + "\n// Each implements example.test/x/d.Store.\nfunc (r T) Each(f func(Order d.Order) bool, more []d.Order) " + BODY.replace("NAME", "Each")
            + "\n// Save implements example.test/x/d.Store.\nfunc (r T) Save(x int, y int) (n int, m int) " + BODY.replace("NAME", "Save"),
        )
    ],
)
def _implement_file(spark):
    return _text(interfaces.implement(_trees(spark), "example.test/x/d.Store", "T", "t/t.go", repo="x")[0])


@_golden(
    "mock_signatures",
    ["path", "content"],
    [
        (
            "fake/m.go",
            "package fake\n\ntype M struct {\n\tEachFunc func(f func(Order d.Order) bool, more ...d.Order)\n\tOneFunc func() (err error)\n\tSaveFunc func(x int, y int) (n int, m int)\n}\n"
            '\nfunc (m *M) Each(f func(Order d.Order) bool, more ...d.Order)  {\n\tif m.EachFunc == nil {\n\t\tpanic("M.EachFunc not set")\n\t}\n\tm.EachFunc(f, more...)\n}\n'
            '\nfunc (m *M) One() error {\n\tif m.OneFunc == nil {\n\t\tpanic("M.OneFunc not set")\n\t}\n\treturn m.OneFunc()\n}\n'
            '\nfunc (m *M) Save(x int, y int) (n int, m int) {\n\tif m.SaveFunc == nil {\n\t\tpanic("M.SaveFunc not set")\n\t}\n\treturn m.SaveFunc(x, y)\n}\n'
            "\nvar _ d.Store = (*M)(nil)\n",
        )
    ],
)
def _mock_signatures(spark):
    return _text(interfaces.mock(_trees(spark), "d.Store", "M", "fake/m.go", repo="x")[0])


@_golden("interface_circle", ["code", "message"], [("INVALID_ACTION", "interface a.A embeds itself")])
def _circle(spark):
    tree = {"a/a.go": "package a\n\ntype A interface{ B }\n\ntype B interface{ A }\n"}
    try:
        interfaces.resolve(Corpus.of_texts(spark, {"x": tree}), None, "a.A")
        failed = []
    except EngineError as e:
        failed = [(e.code, e.message)]
    return spark.createDataFrame(failed, "code string, message string")


@_golden("conflict", ["method", "want_params", "want_results", "params", "results"], [("Name", 1, 1, 0, 1), ("Run", 1, 0, 0, 0)])
def _conflict(spark):
    tree = {"a.go": "package a\n\ntype T int\n\nfunc (t T) Name() string { return \"\" }\nfunc (t *T) Run() {}\nfunc (t T) Stop() {}\n"}
    need = spark.createDataFrame([("Name", 1, 1), ("Run", 1, 0), ("Stop", 0, 0), ("None", 0, 0)], "method string, want_params int, want_results int")
    return interfaces.conflicts(need, interfaces._own_methods(Corpus.of_texts(spark, {"x": tree}).only(), "*T", "a.go"))


# -- edits that succeed ------------------------------------------------------------------------------------
@_golden("replace_file", ["path", "content"], [("a.go", "package a\n\nfunc Only() {}\n")])
def _replace_file(spark):
    return _text(_run(spark, Action("replace_file", "a.go", content="func Only() {}\n"))[0])


@_golden("delete_func", ["path", "content"], [("a.go", fixtures.EDITS["a.go"].replace("// M does it.\nfunc (t *T) M() {\n\tprintln(1)\n}", ""))])
def _delete_func(spark):
    return _text(_run(spark, Action("delete_func", "a.go", identifier="T.M"))[0])


@_golden("add_struct", ["path", "content"], [("a.go", fixtures.EDITS["a.go"] + "\ntype U struct{}\n\ntype V int\n")])
def _add_struct(spark):
    return _text(_run(spark, Action("add_struct", "a.go", content="type U struct{}\n\ntype V int"))[0])


IFACE = {"p/a.go": "package p\n\n// R reads.\ntype R interface {\n\tOld()\n}\n\ntype S int\n"}
MOCK_R = 'package mocks\n\ntype MockR struct {\n\tNewFunc func() int\n}\n\nfunc (m *MockR) New() int {\n\tif m.NewFunc == nil {\n\t\tpanic("MockR.NewFunc not set")\n\t}\n\treturn m.NewFunc()\n}\n\nvar _ p.R = (*MockR)(nil)\n'


@_golden("update_interface", ["path", "content"], [("mocks/r.go", MOCK_R), ("p/a.go", "package p\n\n// R reads.\ntype R interface {\n\tNew() int\n}\n\ntype S int\n")])
def _update_interface(spark):
    return _text(edits.update_interface(Corpus.of_texts(spark, {"i": IFACE}), "p/a.go", "R", "type R interface {\n\tNew() int\n}", "mocks/r.go", "MockR", repo="i")[0])


@_golden("update_interface_says", ["files_modified", "messages"], [(1, "SUCCESS: Updated R in a.go, regenerated Generated MockR (1 methods) in mocks/r.go")])
def _update_interface_says(spark):
    outcome = edits.update_interface(Corpus.of_texts(spark, {"i": IFACE}), "p/a.go", "R", "type R interface {\n\tNew() int\n}", "mocks/r.go", "MockR", repo="i")[1]
    return outcome.withColumn("messages", F.array_join("messages", "\n"))


@_golden("delete_interface", ["path", "content"], [("p/a.go", "package p\n\n\n\ntype S int\n")])
def _delete_interface(spark):
    return _text(edits.delete_interface(Corpus.of_texts(spark, {"i": IFACE}), "p/a.go", "R", repo="i")[0])


@_golden("plan_file", OUTCOME, [(2, "", None, "", "")])
def _plan_file(spark):
    corpus = _edits(spark)
    plan = "actions:\n- {action: add_func, file: a.go, content: 'func New() {}'}\n- {action: create_file, file: b.go, content: 'func B() {}'}\n- {action: delete_func, file: a.go, identifier: New}\n"
    return _outcome(edits.execute_plan(corpus, plan_frame(corpus, plan, "a"))[1])


@_golden("total_modified", ["n"], [(3,)])
def _total_modified(spark):
    first = _run(spark, Action("add_func", "a.go", content="func New() {}"), Action("create_file", "b.go", content="func B() {}"))[1]
    second = _run(spark, Action("delete_func", "a.go", identifier="Free"))[1]
    return edits.total_modified([first, second]).select(F.col("files_modified").cast("int").alias("n"))


@_golden("field_counts", ["name", "params", "results"], [("F", 3, 2), ("G", 2, 0), ("H", 0, 1)])
def _field_counts(spark):
    tree = {"a.go": "package a\n\nfunc F(a, b int, c string) (int, error) { return 0, nil }\n\nfunc G(int, ...string) {}\n\nfunc H() (err error) { return }\n"}
    d = F.col("d")
    return Corpus.of_texts(spark, {"x": tree}).decls.select(d["name"].alias("name"), columns.field_count(d["params"]).alias("params"), columns.field_count(d["results"]).alias("results"))


# -- text rules and renderings ------------------------------------------------------------------------------
@_golden(
    "text_rules",
    ["rule", "given", "result"],
    [
        ("first type name", "// x\ntype T int", "T"), ("first type name", "func F() {}", "interface"), ("first identifier", "func (s *S) M() {}", "S.M"), ("first identifier", "type T int", "T"), ("first identifier", "x", "content"),
        ("first quoted", 'function "F" already declared as "G"', "F"), ("hint", "NODE_NOT_FOUND", "look the symbol up to find its exact identifier"), ("hint", "NONE", ""),
    ],
)
def _text_rules(spark):
    rules = {"first type name": gotext.first_type_name, "first identifier": gotext.first_identifier, "first quoted": gotext.first_quoted, "hint": lambda code: EngineError(code).hint}
    given = [("first type name", "// x\ntype T int"), ("first type name", "func F() {}"), *(("first identifier", t) for t in ("func (s *S) M() {}", "type T int", "x")), ("first quoted", 'function "F" already declared as "G"')]
    return spark.createDataFrame([(rule, text, rules[rule](text)) for rule, text in [*given, ("hint", "NODE_NOT_FOUND"), ("hint", "NONE")]], "rule string, given string, result string")


def _texts(spark: SparkSession, **texts: str) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "kind string, text string")


@_golden(
    "graph_text",
    ["kind", "text"],
    [
        ("plain", "pkg/domain → (none)\npkg/domain/store → pkg/domain\n"),
        ("empty", "No Go packages found in 'nowhere'.\nHint: check that you're in the project root, or use '--dir <path>' to target a subdirectory.\n"),
        ("symbols", "pkg/domain/store/store.go\n  type Store interface { Save; Load; Closer }\n  type Closer interface { Close }\n"),
        ("none", "No Go files found in 'pkg'.\nHint: use '--dir <path>' to target a package directory, or '-r' to walk sub-packages.\n"),
        ("children", "\nSub-packages (use -r to include): app, domain\n"),
        ("tool", "_draft\n\nbroken\n\npkg/app\n\npkg/domain\n\npkg/domain/store\npkg/domain/store/store.go\n  type Store interface { Save; Load; Closer }\n  type Closer interface { Close }\n"),
    ],
)
def _graph_text(spark):
    shop = _shop(spark)
    show = lambda o, **more: render.graph_text(graph(shop, o.implied()), o, **more)
    return _texts(
        spark,
        plain=show(GraphOptions(dir="pkg/domain", summary=True, deps=True)),
        empty=show(GraphOptions(dir="nowhere")),
        symbols=show(GraphOptions(dir="pkg/domain/store", symbols=True)),
        none=show(GraphOptions(dir="pkg", symbols=True)),
        children=show(GraphOptions(dir="pkg", symbols=True), children=[r["name"] for r in sub_packages(shop, "pkg").collect()]),
        tool=show(GraphOptions(focus="pkg/domain/store"), style="tool"),
    )


@_golden(
    "symbol_text",
    ["kind", "text"],
    [
        ("one", "Symbol: NewOrder\nFile: pkg/domain/order.go:15-17 (3 lines body)\nDoc:\nNewOrder makes an empty order.\nSignature:\nfunc NewOrder(id OrderID) *Order\n"),
        ("many", "Found 2 matches for 'F'. Please refine your search:\n\nMatches (Functions):\n- F in a.go:2\n\nMatches (Structs):\n- F in b/b.go:2\n\nHint: refine with 'symbol query=F dir=.'.\n"),
        ("none", "No symbols found matching 'Nope'.\n"),
        ("report", "  Customer struct{} (lines 3-3)\n  func (c Customer) Name() string (lines 6-6)\n  Visitor = Customer (lines 8-8)\n"),
    ],
)
def _symbol_text(spark):
    shop, many = _shop(spark), Corpus.of_texts(spark, {"m": {"a.go": "package a\nfunc F() {}\n", "b/b.go": "package b\ntype F int\n"}})
    return _texts(
        spark,
        one=render.symbol_text(symbols.resolve(shop, "NewOrder"), "NewOrder"),
        many=render.symbol_text(symbols.resolve(many, "F"), "F"),
        none=render.symbol_text(symbols.resolve(shop, "Nope"), "Nope"),
        report=render.report_text(symbols.file_report(shop, "pkg/domain/customer.go")),
    )


@_golden(
    "outcome_text",
    ["kind", "text"],
    [
        ("done", 'WARNING: update_func: identifier "Gone" not found in a.go, treated as add_func\nSUCCESS: 1 file(s) modified\n'),
        ("failed", "[NODE_NOT_FOUND] node not found\nHint: look the symbol up to find its exact identifier\n"),
    ],
)
def _outcome_text(spark):
    done, failed = Action("update_func", "a.go", identifier="Gone", content="func Gone() {}"), Action("delete_func", "a.go", identifier="Nope")
    return _texts(spark, done=render.outcome_text(_run(spark, done)[1]), failed=render.outcome_text(_run(spark, failed)[1]))


# -- trees on disk -------------------------------------------------------------------------------------------
def _on_disk(spark: SparkSession) -> dict[str, str]:
    """The shop as files below the folder that driver and executors share."""
    root = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/golden-shop"
    tree = {**fixtures.SHOP, "_under.go": "package x\n", ".dot.go": "package x\n", "readme.md": "no"}
    write_tree(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in tree.items()], "path string, content binary").coalesce(1), root)
    return {"disk": root}


@_golden("source_files", ["repo", "path"], [("disk", p) for p in sorted([".dot.go", "_under.go", *(p for p in fixtures.SHOP if not p.startswith((".cache", "vendor")))])])
def _source_files(spark):
    return Corpus.of_roots(spark, _on_disk(spark), batch="3").files


@_golden("source_directory", ["path"], [("pkg/app/doc.go",), ("pkg/app/service.go",)])
def _source_directory(spark):
    return Corpus.of_roots(spark, _on_disk(spark), dir="pkg/app", recursive="false").go_files


@_golden("source_pruned", ["n", "path", "deps"], [(1, ".", None), (2, "_draft", None), (3, "pkg/domain", None)])
def _source_pruned(spark):
    rows = graph(Corpus.of_roots(spark, _on_disk(spark)), GraphOptions(deps=True, exclude=("a*", "b*"), depth=2))
    return rows.select(F.col("ord").alias("n"), "path", F.array_join("deps", ",").alias("deps"))


@_golden("source_symbols", ["file", "name", "signature"], [("pkg/domain/order.go", "NewOrder", "func NewOrder(id OrderID) *Order")])
def _source_symbols(spark):
    return symbols.find_symbols(Corpus.of_roots(spark, _on_disk(spark)), symbols.SymbolQuery("NewOrder"))


@_golden("written_and_read", ["path", "content"], [("n/n.go", "package n\n\nfunc N() {}\n")])
def _written_and_read(spark):
    root = f"{_on_disk(spark)['disk']}-written"
    changed, _ = edits.run_action(_edits(spark), Action("add_func", "n/n.go", package="n", content="func N() {}"), "a")
    edits.settle(_edits(spark), changed, "write", root)
    return _text(Corpus.of_roots(spark, {"w": root}).files)


@_golden(
    "written_in_layout",
    ["path", "content"],
    [
        (
            "fake/m.go",
            "package fake\n\ntype M struct {\n\tEachFunc func(f func(Order d.Order) bool, more ...d.Order)\n\tOneFunc  func() (err error)\n\tSaveFunc func(x int, y int) (n int, m int)\n}\n"
            '\nfunc (m *M) Each(f func(Order d.Order) bool, more ...d.Order) {\n\tif m.EachFunc == nil {\n\t\tpanic("M.EachFunc not set")\n\t}\n\tm.EachFunc(f, more...)\n}\n'
            '\nfunc (m *M) One() error {\n\tif m.OneFunc == nil {\n\t\tpanic("M.OneFunc not set")\n\t}\n\treturn m.OneFunc()\n}\n'
            '\nfunc (m *M) Save(x int, y int) (n int, m int) {\n\tif m.SaveFunc == nil {\n\t\tpanic("M.SaveFunc not set")\n\t}\n\treturn m.SaveFunc(x, y)\n}\n'
            "\nvar _ d.Store = (*M)(nil)\n",
        )
    ],
)
def _written_in_layout(spark):
    root = f"{_on_disk(spark)['disk']}-mock"
    write_tree(interfaces.mock(_trees(spark), "d.Store", "M", "fake/m.go", repo="x")[0], root)
    return _text(Corpus.of_roots(spark, {"w": root}).files)
