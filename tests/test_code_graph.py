import datetime as dt

import pytest

from codeweft.operators import graph
from codeweft.operators.schema import LABELS, RELATIONS, legal_pairs
from codeweft.plans import tools
from codeweft.sources.code_graph import CodeGraph

T = dt.datetime(2024, 1, 1)
CONTROLLER = """<?php
namespace App;
use App\\Order;
class OrderController extends Base
{
    public function index(Order $o)
    {
        $this->total();
        Order::query()->where('a', 1)->get();
        return config('shop.limit');
    }
    private function total()
    {
        Order::create([]);
        event(new OrderRaised(1));
    }
    public function nobody()
    {
    }
}
"""
FILES = [
    (1, "r", "app/Http/OrderController.php", ".php", None, CONTROLLER), (2, "r", "routes/web.php", ".php", "route_file", "<?php\nRoute::get('/orders', [OrderController::class, 'index']);\n"),
    (3, "r", "app/Order.php", ".php", "model", "<?php\nnamespace App;\nclass Order {}\n"), (4, "r", "app/OrderRaised.php", ".php", "event", "<?php\nnamespace App;\nclass OrderRaised {}\n"), (5, "r", "app/Base.php", ".php", None, "<?php\nnamespace App;\nclass Base { function nobody() {} }\n"),
    (6, "r", "config/shop.php", ".php", None, "<?php\nreturn [\n    'limit' => env('LIMIT_ROWS'),\n];\n"), (7, "r", "resources/views/a/b.blade.php", ".blade.php", "blade", "@extends('c')"), (8, "r", "resources/views/c.blade.php", ".blade.php", "blade", "x"),
    (9, "r", "database/migrations/1.php", ".php", "migration", "<?php\nSchema::create('orders', function ($table) {\n    $table->id();\n    $table->string('a');\n    });\n"), (10, "r", "gone.php", ".php", None, None),
]


@pytest.fixture(scope="module")
def code(spark):
    f = spark.createDataFrame
    cls = [(i, "r", n, f"App\\{n}", fid, f"app/{n}.php", "class", 4, 30, ext, [], [], T, None) for i, (n, fid, ext) in enumerate([("OrderController", 1, "app\\BASE"), ("Order", 3, None), ("OrderRaised", 4, None), ("Base", 5, None)])]
    met = [(i, f"method:{c}::{n}", "r", fid, f"app/{c}.php", n, f"App\\{c}::{n}", a, z, '["Order"]' if n == "index" else "[]", "", T) for i, (c, n, fid, a, z) in enumerate([("OrderController", "index", 1, 6, 11), ("OrderController", "total", 1, 12, 16), ("OrderController", "nobody", 1, 17, 19), ("Base", "nobody", 5, 3, 3)])]
    t = {
        "source_files": f(FILES, "file_id long, repo string, path string, extension string, laravel_role string, content string"),
        "parsed_classes": f(cls, "class_id long, repo string, name string, fqn string, file_id long, file_path string, kind string, line_start int, line_end int, extends string, implements array<string>, traits array<string>, parsed_at timestamp, removed_at timestamp"),
        "methods": f([*met, met[0]], "method_id long, node_id string, repo string, file_id long, file_path string, name string, fqn string, line_start int, line_end int, param_types string, return_type string, parsed_at timestamp"),
        "parsed_uses": f([(1, "app\\order", 3, "Order")], "file_id long, fqn string, line int, alias string"),
        "eloquent_models": f([(1, "model:Order", "r", "Order", "App\\Order", "app/Order.php", None, T)], "model_id long, node_id string, repo string, name string, fqn string, file_path string, db_table string, parsed_at timestamp"),
        "db_tables": f([(1, "table:orders", "r", "ORDERS", "main", "live_db", T, None), (2, "table:old", "r", "old", "main", "live_db", T, T)], "table_id long, node_id string, repo string, name string, connection string, source string, created_at timestamp, dropped_at timestamp"),
    }
    g = CodeGraph(t.__getitem__)
    return g, g.nodes().cache(), g.edges().cache(), t


def pairs(edges, rel):
    return {(r["src"].split(":", 1)[1], r["dst"].split(":", 1)[1]) for r in edges.filter(f"rel = '{rel}'").collect()}


def test_edges_of_every_kind(code):
    _, nodes, edges, _ = code
    assert pairs(edges, "EXTENDS_CLASS") == {("app\\ordercontroller", "app\\base")}
    assert pairs(edges, "ROUTES_TO") == {("r::GET:/orders", "OrderController::index")}
    assert pairs(edges, "CALLS") == {("OrderController::index", "OrderController::total"), ("OrderController::index", "app\\order"), ("OrderController::total", "app\\order")}
    assert pairs(edges, "DISPATCHES") == {("OrderController::total", "app\\orderraised")}
    assert pairs(edges, "USES_TYPE") == {("OrderController::index", "app\\order")}
    assert pairs(edges, "QUERIES_TABLE") == {("OrderController::index", "orders"), ("OrderController::total", "orders")}
    assert pairs(edges, "USES_TABLE") == {("Order", "orders")} and pairs(edges, "HAS_COLUMN") == {("orders", "r::orders::id"), ("orders", "r::orders::a")}
    assert pairs(edges, "EXTENDS_TEMPLATE") == {("r::a.b", "r::c")} and pairs(edges, "IMPORTS") == {("r::app/Http/OrderController.php", "r::app/Order.php")}
    assert pairs(edges, "USES_ENV") == {("r::config/shop.php", "r::LIMIT_ROWS")} and ("r::app/Http/OrderController.php", "r::shop.limit") in pairs(edges, "USES_CONFIG")
    assert ("r::app", "r::app/Http") in pairs(edges, "CONTAINS")
    assert nodes.groupBy("node_id").count().filter("count > 1").count() == 0


def test_all_edges_are_declared(spark, code):
    _, nodes, edges, _ = code
    assert graph.undeclared_pairs(edges, nodes, legal_pairs(spark)).collect() == []
    assert len(LABELS) == len(set(LABELS)) == 50 and len(RELATIONS) == len(set(RELATIONS)) == 55
    assert {r["label"] for r in nodes.select("label").distinct().collect()} <= set(LABELS) and {r["rel"] for r in edges.select("rel").distinct().collect()} <= set(RELATIONS)


def test_tools(code):
    g, nodes, edges, t = code
    seed = nodes.filter("node_id = 'table:orders'")
    assert {r["node"].split(":", 1)[1] for r in tools.impact(nodes, edges, nodes.filter("name = 'total'"), 3).collect()} >= {"OrderController::index", "orders", "r::GET:/orders"}
    assert {(r["name"], r["depth"]) for r in tools.request_flow(nodes, edges, nodes.filter("label = 'Route'")).collect()} == {("index", 1), ("total", 2), ("ORDERS", 2), ("Order", 2), ("OrderRaised", 3)}
    assert {r["name"] for r in tools.dead_methods(nodes, edges).collect()} == {"nobody"}
    a = tools.table_access(nodes, edges).first()
    assert (a["n_reads"], a["n_writes"], a["conflict"]) == (1, 1, True)
    assert [(r["method"], r["target_name"]) for r in tools.write_impact(nodes, edges, seed).collect()] == [("method:OrderController::total", "OrderRaised")]
    assert {r["other_name"] for r in tools.context(nodes, edges, nodes.filter("name = 'OrderRaised'")).collect()} == {"OrderRaised.php", "total", "orders"}
    assert {(r["key"], r["kind"], r["declared"]) for r in tools.setting_usage(nodes, edges).collect()} == {("shop.limit", "config", True), ("LIMIT_ROWS", "env", True)}
    assert tools.find(nodes.filter("label <> 'Feature'"), "ORDERS").first()["node_id"] == "table:orders" and tools.find(nodes, "app\\order").first()["name"] == "Order"
    fl = [(r["node"], r["depth"], r["step_order"]) for r in tools.flows(nodes, edges).orderBy("step_order").collect()]
    assert fl == [("method:OrderController::index", 0, 0), ("method:OrderController::total", 1, 1)]
    f = {(r["feature"], r["match_type"]) for r in tools.features(g.routes().select("node_id", "uri"), nodes.filter("label = 'Class_'")).collect()}
    assert f == {("orders", "route"), ("orders", "exact")}
    assert {r["name"] for r in tools.symbols_without_use(nodes, edges).collect()} == {"OrderController"}
    assert tools.cross_cutting(nodes, edges, 1, 1).count() == 1
    assert tools.coverage(t["source_files"].selectExpr("file_id as route_id").limit(4), t["source_files"].limit(1).selectExpr("'route' as kind", "file_id as target")).first()["percent"] == 25.0


class Small:
    """A graph from frames, with the labels and relations asked for only."""

    def __init__(self, nodes, edges):
        self._nodes, self._edges = nodes, edges

    def nodes(self, *labels):
        return self._nodes.filter(self._nodes["label"].isin(*labels))

    def edges(self, *rels):
        return self._edges.filter(self._edges["rel"].isin(*rels))


def test_impact_query_starts_from_every_symbol_and_meets_users_of_traits(spark, frame, monkeypatch):
    from codeweft.plans import tool_queries

    nodes = frame([("t", "Trait_", "T"), ("i", "Interface_", "I"), ("c", "Class_", "C"), ("d", "Class_", "D"), ("e", "Class_", "E"), ("m", "Method", "m"), ("tab", "DatabaseTable", "tab")], "node_id string, label string, name string")
    edges = frame([("c", "USES_TRAIT", "t"), ("c", "IMPLEMENTS_INTERFACE", "i"), ("d", "EXTENDS_CLASS", "c"), ("e", "EXTENDS_CLASS", "d"), ("m", "QUERIES_TABLE", "tab")], "src string, rel string, dst string")
    monkeypatch.setattr(tool_queries, "_graph", lambda s, d: Small(nodes, edges))
    got = {(r["root"], r["node"], r["depth"]) for r in tool_queries.tool_impact(spark, "").collect()}
    assert got == {(x, y, n) for x in "ti" for n, y in enumerate("cde", 1)} | {("c", "d", 1), ("c", "e", 2), ("d", "e", 1), ("m", "tab", 1)}


def test_request_flow_query_follows_every_edge_of_a_node(spark, frame, monkeypatch):
    from codeweft.plans import tool_queries

    names = [f"m{i:02}" for i in range(14)]
    nodes = frame([("r", "Route", "r"), ("h", "Method", "h"), *[(x, "Method", x) for x in names], ("z", "DatabaseTable", "z")], "node_id string, label string, name string")
    edges = frame([("r", "ROUTES_TO", "h"), *[("h", "CALLS", x) for x in names], ("h", "QUERIES_TABLE", "z")], "src string, rel string, dst string")
    monkeypatch.setattr(tool_queries, "_graph", lambda s, d: Small(nodes, edges))
    assert {r["node"] for r in tool_queries.tool_request_flow(spark, "").collect()} == {"h", "z", *names}


def test_inventories(spark, code):
    from codeweft.plans import catalog_tools as c

    g, _, _, t = code
    r = c.route_list(g).first()
    assert (r["http_method"], r["uri"], r["handler"]) == ("GET", "/orders", "method:OrderController::index")
    assert [tuple(x) for x in c.api_surface(g).collect()] == [("r", "orders", "GET", 1, 0, 1)] and c.guarded_share(g).first()["percent"] == 0.0
    assert [(x["name"], x["columns"]) for x in c.schema_list(g).withColumnRenamed("table_name", "name").collect()] == [("orders", ["a", "id"])]
    x = c.table_context(g).first()
    assert (x["name"], x["n_columns"], x["n_models"], x["n_readers"], x["n_writers"]) == ("orders", 2, 1, 1, 1)
    assert [tuple(x) for x in c.connection_map(g).collect()] == [("r", "main", 1, 1, 2)]
    assert {(x["column"], x["n_models"]) for x in c.column_context(CodeGraph({**t, "eloquent_models": spark.createDataFrame([(1, "m", "r", "Order", "App\\Order", None, '["a"]', '{"a": "int"}', True, True, T)], "model_id long, node_id string, repo string, name string, fqn string, db_table string, fillable string, casts string, soft_deletes boolean, timestamps boolean, parsed_at timestamp")}.__getitem__)).collect()} == {("id", 1), ("a", 1)}
    e = {x["node_id"]: x for x in c.explained(g).collect()}["class_:app\\ordercontroller"]
    assert (e["n_methods"], e["n_parents"], e["n_children"], e["n_users"]) == (3, 1, 0, 0)
    p = spark.createDataFrame([("r", "p1", "SELECT * FROM orders; UPDATE `Orders` SET a = 1"), ("r", "p2", None)], "repo string, name string, body string")
    assert {(x["name"], x["n_reads"], x["n_writes"]) for x in c.procedure_list(p).collect()} == {("p1", 1, 1), ("p2", 0, 0)}
    assert sorted(x["operation"] for x in c.procedure_context(p, g).collect()) == ["read", "write"]
    k = spark.createDataFrame([("main", {"host": "${DB_HOST}", "port": "3306", "database": "env:MISSING"})], "name string, settings map<string,string>")
    got = {(x["key"], x["value"], x["source"]) for x in c.resolved_connections(k, spark.createDataFrame([("DB_HOST", "h"), ("DB_USERNAME", "u")], "key string, value string")).collect()}
    assert got == {("host", "h", "env"), ("port", "3306", "given"), ("username", "u", "env")}


def test_security_surface(spark, code):
    from codeweft.plans import catalog_tools as c

    _, _, _, t = code
    text = "<?php\nRoute::post('/stripe/webhook', [OrderController::class, 'nobody']);\n" + "".join(f"Route::get('/shop/{i}', [OrderController::class, 'index'])->middleware('auth');\n" for i in range(3)) + "Route::get('/shop/open', [OrderController::class, 'index']);\n"
    mig = "<?php\nSchema::create('orders', function ($table) {\n    $table->string('card_number');\n    $table->string('card_title');\n    });\n"
    files = [f for f in FILES if f[0] not in (2, 9)] + [(2, "r", "routes/web.php", ".php", "route_file", text), (9, "r", "database/migrations/1.php", ".php", "migration", mig)]
    g = CodeGraph({**t, "source_files": spark.createDataFrame(files, t["source_files"].schema)}.__getitem__)
    assert sorted((x["severity"], x["kind"], x["location"]) for x in c.security_surface(g).collect()) == [("CRITICAL", "UNVERIFIED_WEBHOOK", "POST /stripe/webhook"), ("HIGH", "SENSITIVE_DATA_RETENTION", "orders.card_number"), ("MEDIUM", "MISSING_AUTH", "GET /shop/open")]


def test_relations_of_the_framework(spark, code):
    _, _, _, t = code
    more = """<?php
namespace App;
class ShopController
{
    public function __construct(private Base $base) {}
    public function store(SaveRequest $r)
    {
        foreach ($rows as $row) {
            $row->a->b();
        }
        Http::post('https://x');
        return view('c');
    }
}
"""
    extra = [
        (11, "r", "app/Http/Controllers/ShopController.php", ".php", None, more), (12, "r", "app/Http/Requests/SaveRequest.php", ".php", None, "<?php\nnamespace App;\nclass SaveRequest {}\n"),
        (13, "r", "app/Listeners/Mail.php", ".php", None, "<?php\nuse App\\OrderRaised;\nclass Mail { function handle(OrderRaised $e) {} }\n"), (14, "r", "resources/views/components/badge.blade.php", ".blade.php", "blade", "x"),
        (15, "r", "resources/views/d.blade.php", ".blade.php", "blade", "<x-badge />"), (16, "r", "app/Providers/P.php", ".php", None, "<?php\n$this->app->bind(Base::class, Order::class);\n"), (17, "r", "tests/Feature/T.php", ".php", None, "<?php\nclass T { function t() { $this->get('/orders'); Order::factory(); } }"),
        (18, "r", "app/Order.php", ".php", "model", "<?php\nclass Order { public function bases() { return $this->hasMany(Order::class); } }\n"),
    ]
    files = [f for f in FILES if f[0] not in (2, 3, 9)] + extra + [(2, "r", "routes/web.php", ".php", "route_file", "<?php\nRoute::get('/orders', [OrderController::class, 'index'])->middleware('auth:api');\n"), (9, "r", "database/migrations/1.php", ".php", "migration", "<?php\nSchema::create('orders', function ($table) {\n    $table->foreignId('order_id');\n    });\n")]
    cls = t["parsed_classes"].unionByName(spark.createDataFrame([(20 + i, "r", n, f"App\\{n}", fid, p, "class", 1, 30, None, [], [], T, None) for i, (n, fid, p) in enumerate([("ShopController", 11, "app/Http/Controllers/ShopController.php"), ("SaveRequest", 12, "app/Http/Requests/SaveRequest.php"), ("Mail", 13, "app/Listeners/Mail.php")])], t["parsed_classes"].schema))
    met = t["methods"].unionByName(spark.createDataFrame([(20, "method:Shop::store", "r", 11, "app/Http/Controllers/ShopController.php", "store", "App\\ShopController::store", 6, 13, '["SaveRequest"]', "", T)], t["methods"].schema))
    g = CodeGraph({**t, "source_files": spark.createDataFrame(files, t["source_files"].schema), "parsed_classes": cls, "methods": met}.__getitem__)
    got = {(r["rel"], r["src"].split(":", 1)[1], r["dst"].split(":", 1)[1]) for r in g.edges("INJECTS", "RENDERS_TEMPLATE", "HAS_COMPONENT", "LISTENS_TO", "BINDS_TO", "HAS_RELATIONSHIP", "REFERENCES_TABLE", "APPLIES_MIDDLEWARE", "VALIDATES_WITH", "CALLS_EXTERNAL", "TESTS", "HAS_PERFORMANCE_RISK").collect()}
    assert got >= {
        ("INJECTS", "app\\shopcontroller", "app\\base"), ("RENDERS_TEMPLATE", "Shop::store", "r::c"), ("HAS_COMPONENT", "r::d", "r::components.badge"), ("LISTENS_TO", "app\\mail", "app\\orderraised"), ("BINDS_TO", "app\\base", "app\\order"), ("HAS_RELATIONSHIP", "Order", "Order"),
        ("REFERENCES_TABLE", "r::orders::order_id", "orders"), ("APPLIES_MIDDLEWARE", "r::GET:/orders", "r::auth"), ("VALIDATES_WITH", "Shop::store", "app\\saverequest"), ("TESTS", "17", "r::GET:/orders"), ("TESTS", "17", "app\\order"),
    }
    assert {r for r, _, _ in got} >= {"CALLS_EXTERNAL", "HAS_PERFORMANCE_RISK"}
    assert {r["name"] for r in g.nodes("Middleware", "Feature", "PerformanceRisk").collect()} == {"auth", "orders", "n_plus_one"}
