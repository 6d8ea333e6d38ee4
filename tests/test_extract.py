import pytest
from pyspark.sql import functions as F

from codeweft.operators import extract, quality
from codeweft.sources import files as src

CONTROLLER = """<?php

namespace App\\Http;

use App\\Models\\Order as Sale;
use \\Lib\\Tool;

class OrderController extends Base
{
    public function __construct(private Mailer $mailer, int $n) {}

    public function index()
    {
        // $this->hidden();
        $rows = Order::query()->where('x', 1)->get();
        if ($rows->total > 3) {
            event(new OrderRaised($rows));
        }
        foreach ($rows as $row) {
            echo $row->customer->name;
        }
        SyncJob::dispatch($rows);
        $this->index();
        $n = config('shop.limit', 5);
        return view('orders.index');
    }
}
"""
ROUTES = """<?php
Route::get('/orders', [OrderController::class, 'index']);
Route::post('/orders', 'OrderController@store');
Route::apiResource('items', ItemController::class);
"""
MIGRATION = """<?php
return new class extends Migration {
    public function up(): void
    {
        Schema::create('posts', function ($table) {
            $table->id();
            $table->string('title')->unique();
            $table->foreignId('author_id')->constrained('users');
            $table->foreignId('category_id')->nullable();
            $table->timestamps();
            $table->softDeletes();
        });
    }
};
"""
FILES = [
    (1, "app/Http/OrderController.php", CONTROLLER), (2, "routes/web.php", ROUTES), (3, "database/migrations/1_posts.php", MIGRATION),
    (4, "resources/views/orders/index.blade.php", "@extends('layouts.app')\n{{-- @include('no') --}}@include('orders.row')<x-badge />"),
    (5, "config/shop.php", "<?php\nreturn [\n    'limit' => env('SHOP_LIMIT', 5),\n    'deep' => [\n        'no' => 1,\n    ],\n];\n"),
    (6, "app/Providers/P.php", "<?php\nclass P {\n  protected $listen = [ OrderRaised::class => [ SendMail::class, Log::class ] ];\n function register() { $this->app->singleton(Gate::class, RealGate::class); app()->bind(X::class, fn () => 1); } }"),
    (7, "app/Models/Category.php", "<?php\nclass Category { use SoftDeletes; protected $fillable = ['a', 'b']; protected $casts = ['a' => 'string', 'b' => 'array', 'a' => 'int']; public function items() { return $this->hasMany(Item::class, 'cat_id'); } }"),
    (8, "tests/Feature/OrderTest.php", "<?php\nclass OrderTest { function t() { $this->getJson('/orders/1'); Order::factory(); } }"),
    (9, "app/Notifications/N.php", "<?php\nclass N { public function via($x): array { return ['mail', 'database']; } }"),
    (10, "app/Http/Requests/R.php", "<?php\nclass R {\n    public function rules(): array\n    {\n        return ['name' => 'required|max:3', 'tags' => ['array', 'min:1']];\n    }\n}\n"),
    (11, "app/Jobs/H.php", "<?php\nclass H { function send() {\n Http::post('https://x.example');\n } }"),
    (12, "a.php", None), (13, "empty.php", ""),
]


@pytest.fixture(scope="module")
def php(spark):
    return spark.createDataFrame(FILES, "file_id int, path string, content string").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_declarations_and_imports(php):
    assert rows(extract.imports(php), "fqn", "alias") == [("App\\Models\\Order", "Sale"), ("Lib\\Tool", "Tool")]
    assert ("App\\Http\\OrderController", "Base") in rows(extract.declared_classes(php).filter("parent is not null"), "fqn", "parent")
    assert rows(extract.import_edges(php, php.filter("file_id = 7").select(F.lit("Lib\\Tool").alias("fqn"), "file_id")), "file_id", "target_file_id") == [(1, 7)]


def test_calls_and_dispatches(php):
    c = rows(extract.calls(php).filter("file_id = 1"), "kind", "name")
    assert ("self", "index") in c and ("static", "query") in c and all(n != "hidden" for _, n in c)
    assert rows(extract.dispatches(php), "target", "dispatch_type") == [("OrderRaised", "event"), ("SyncJob", "job")]
    g = extract.guards(php, extract.dispatches(php).filter("target = 'OrderRaised'"))
    assert g.first()["condition"].startswith("if ($rows->total")


def test_calls_follow_the_receiver(spark, frame):
    text = "<?php\nclass A {\n function f() {\n  $this->own(); self::gone(); User::find(1); Sale::total(); Cache::put(1); $user->save2(); helper(); view('x'); parent::f(); Nobody::x();\n }\n}\n"
    sites = extract.calls(frame([(1, text)], "file_id int, content string")).withColumn("repo", F.lit("r")).withColumn("caller_key", F.lit("app\\a"))
    methods = frame([("app\\a", "own", "m:own"), ("app\\models\\user", "other", "m:o"), ("app\\order", "total", "m:total"), ("lib\\x", "find", "m:wrong")], "class_key string, name string, node_id string")
    symbols = frame([("app\\a", "App\\A", "A", "r", "c:a"), ("app\\models\\user", "App\\Models\\User", "User", "r", "c:u"), ("a\\user", "A\\User", "User", "r", "c:x"), ("app\\order", "App\\Order", "Order", "r", "c:o"), ("illuminate\\cache\\repository", "Illuminate\\Cache\\Repository", "Repository", "r", "c:cache"), ("app\\user2", "App\\user", "user", "r", "c:var")], "key string, fqn string, name string, repo string, node_id string")
    aliases = frame([(1, "Sale", "app\\order")], "file_id int, alias string, key string")
    got = {(r["name"], r["target"], r["call_type"], r["confidence"]) for r in extract.resolved_calls(sites, methods, symbols, aliases).collect()}
    assert got == {("own", "m:own", "self", 0.9), ("gone", "c:a", "self", 0.6), ("find", "c:u", "static", 0.7), ("total", "m:total", "static", 0.85), ("put", "c:cache", "facade", 0.75), ("save2", "c:var", "instance", 0.4), ("helper", "c:a", "self", 0.6)}


def test_dispatch_kinds(frame):
    text = "<?php\nevent(new OrderPlaced(1));\ndispatch(new SendMail(\n1)); Event::dispatch(new Sold(2)); dispatchIf($a, new PaidEvent(1)); SyncJob::dispatch(); BillNotification::dispatch(); Bus::dispatch($x); $stack->push(new Item(1));\n$this->dispatch(\n  new Lib\\Late(1));\n"
    got = sorted((r["line"], r["target"], r["dispatch_type"]) for r in extract.dispatches(frame([(1, text), (2, None), (3, "")], "file_id int, content string")).collect())
    assert got == [(2, "OrderPlaced", "event"), (3, "SendMail", "job"), (4, "BillNotification", "event"), (4, "PaidEvent", "event"), (4, "Sold", "event"), (4, "SyncJob", "job"), (5, "Late", "job")]


def test_route_groups_resources_and_closures(frame):
    text = """<?php
use A\\OrderController as OC;
Route::get('/a', [OC::class, 'index'])->name('a.index')->middleware('auth');
Route::prefix('api')->middleware(['web', 'x'])->group(function () {
  Route::group(['prefix' => 'v1', 'middleware' => ['q', R::class]], function () {
     Route::apiResource('items', ItemController::class)->only(['index', 'show']);
     Route::resource('notes', NoteController::class)->except('edit', 'create', 'update', 'destroy');
     Route::post('p', fn () => (new PayController())->pay());
  });
  Route::controller(K::class)->group(function () { Route::get('/k', 'go'); });
  // Route::get('/no', 'x@y');
  Route::match(['get', 'post'], 'm', 'Foo@bar');
  Route::get('c', function (OrderController $c) { return $c->show(1); });
  Route::get('d', function () { return view("a } b"); })->name('d');
});
Route::get('i', Inv::class);
"""
    got = [(r["http_method"], r["uri"], r["controller"], r["action"], r["middleware"]) for r in extract.routes(frame([(1, text), (2, None), (3, "x")], "file_id int, content string")).orderBy("position").collect()]
    assert got == [
        ("GET", "/a", "A\\OrderController", "index", ["auth"]), ("GET", "/api/v1/items", "ItemController", "index", ["q", "R"]), ("GET", "/api/v1/items/{id}", "ItemController", "show", ["q", "R"]),
        ("GET", "/api/v1/notes", "NoteController", "index", ["q", "R"]), ("POST", "/api/v1/notes", "NoteController", "store", ["q", "R"]), ("GET", "/api/v1/notes/{id}", "NoteController", "show", ["q", "R"]), ("POST", "/api/v1/p", "PayController", "pay", ["q", "R"]),
        ("GET", "/api/k", "K", "go", ["web", "x"]), ("GET", "/api/m", "Foo", "bar", ["web", "x"]), ("POST", "/api/m", "Foo", "bar", ["web", "x"]), ("GET", "/api/c", "OrderController", "show", ["web", "x"]), ("GET", "/api/d", None, None, ["web", "x"]), ("GET", "i", "Inv", "__invoke", []),
    ]


def test_routes_expand_resources(php):
    x = rows(extract.routes(php).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("http_method", "uri", "controller", "action")]), "http_method", "uri", "controller", "action")
    assert ("GET", "/orders", "OrderController", "index") in x and ("POST", "/orders", "OrderController", "store") in x
    assert ("DELETE", "items/{id}", "ItemController", "destroy") in x and len(x) == 7


def test_migrations_spell_out_shorthands(php):
    x = {r["column"]: r for r in extract.migration_columns(php).collect()}
    assert set(x) == {"id", "title", "author_id", "category_id", "created_at", "updated_at", "deleted_at"}
    assert x["title"]["is_unique"] and x["author_id"]["references_table"] == "users" and x["category_id"]["references_table"] == "categories" and x["category_id"]["nullable"]


def test_templates_config_and_bindings(php):
    assert rows(extract.templates(php), "rel", "target") == [("EXTENDS_TEMPLATE", "layouts.app"), ("HAS_COMPONENT", "badge"), ("INCLUDES_TEMPLATE", "orders.row")]
    assert rows(extract.renders(php), "template") == [("orders.index",)]
    assert rows(extract.config_uses(php), "kind", "key") == [("config", "shop.limit"), ("env", "SHOP_LIMIT")]
    assert rows(extract.config_keys(php), "key") == [("shop.deep",), ("shop.limit",)]
    assert sorted((r["abstract"], r["concrete"]) for r in extract.bindings(php).collect() if r["concrete"]) == [("Gate", "RealGate")]
    assert rows(extract.listeners(php), "event", "listener") == [("OrderRaised", "Log"), ("OrderRaised", "SendMail")]


def test_models_tests_requests_and_notifications(php):
    m = extract.model_facts(php).first()
    assert (m["db_table"], m["soft_deletes"], m["fillable"], m["casts"]) == ("categories", True, ["a", "b"], {"a": "int", "b": "array"})
    assert rows(extract.model_relations(php), "relation", "target", "foreign_key") == [("hasMany", "Item", "cat_id")]
    assert extract.test_references(php).first()["uris"] == ["/orders/1"]
    assert rows(extract.notification_channels(php), "channel") == [("database",), ("mail",)]
    assert {r["field"]: r["rules"] for r in extract.validation_rules(php).collect()} == {"name": ["required", "max:3"], "tags": ["array", "min:1"]}
    assert ("mass_assignment", "a") in rows(extract.contracts(php), "kind", "subject")
    assert rows(extract.http_calls(php), "client", "verb", "caller") == [("facade", "POST", "send")]
    assert ("constructor", "Mailer") in rows(extract.injections(php), "injection", "type")


def test_risks_and_races_by_method(frame):
    body = lambda *lines: "\n".join(lines)
    rows_ = [
        ("a", "index2", "controller", "app/A.php", body("function a() {", " foreach ($rows as $row) {", "  echo $row->customer->name;", " }", "}")), ("b", "b", "model", "app/B.php", body("f() {", " $q->with('c');", " foreach ($rows as $k => $row) {", "  $row->c->d();", " } }")),
        ("c", "c", "service", "app/C.php", body("f() {", " $a->count(); $b->count();", " DB::select('x'); DB::raw('y'); $x->load('z');", "}")), ("d", "d", "job", "app/D.php", "foreach ($a as $b) {\n $b->c->d;\n}"), ("e", "e", "model", "app/tests/E.php", "DB::select('x')"),
        ("f", "pay", "service", "app/F.php", body("f() {", " $o->left = $o->left - 1;", " $o->save();", "}")), ("g", "pay", "service", "app/F.php", body("f() { // lock", " DB::transaction(fn () => 1); $o->left = $o->left - 1;", " $o->save();", "}")),
        ("h", "close", "model", "app/H.php", body("if ($o->status == 'open') {", " $o->status = 'shut';", " $o->save(); }")), ("i", "book", "controller", "app/I.php", body("$n = $x->count();", "if ($n < $max) { Seat::create([]); }")), ("j", "report", "model", "app/J.php", "$o->a = $o->a - 1;\n$o->save();"), ("k", "n", None, None, None),
    ]
    m = frame(rows_, "method string, name string, role string, file_path string, source string")
    got = sorted((r["method"], r["line"], r["risk"], r["severity"]) for r in extract.query_risks(m).collect())
    assert got == [("a", 2, "n_plus_one", "HIGH"), ("b", 3, "missing_eager_load", "MEDIUM"), ("c", 2, "repeated_count", "MEDIUM"), ("c", 3, "raw_query_bypass", "MEDIUM")]
    assert sorted((r["method"], r["pattern"], r["columns"]) for r in quality.race_conditions(m).collect()) == [("f", "ELOQUENT_PROPERTY", "left"), ("h", "STATUS_GATE", "status"), ("i", "CAPACITY_CHECK", "count/capacity")]
    d = frame([("order_type", "string"), ("type", "string"), ("is_x", None), ("n", "smallint(5)"), ("role", "varchar"), (None, None)], "n string, t string")
    assert [r["n"] for r in d.filter(quality.discriminator(F.col("n"), F.col("t"))).collect()] == ["order_type", "is_x", "n"]


def test_method_sources_are_cut_from_the_lines_of_a_file(frame):
    files = frame([(1, "a\nb\r\nc\nd"), (2, None)], "file_id int, content string")
    spans = frame([(1, 2, 3, "x"), (1, 3, None, "y"), (1, 4, 2, "z"), (1, 9, 10, "beyond"), (None, 1, 1, "no"), (2, 1, 1, "null")], "file_id int, line_start int, line_end int, method string")
    assert {r["method"]: r["source"] for r in extract.method_sources(files, spans).collect()} == {"x": "b\nc", "y": "c\nd", "z": "d", "beyond": ""}


def test_sql_bodies(spark):
    df = spark.createDataFrame([("SELECT * FROM `a` JOIN b ON 1",), ("INSERT INTO c SELECT * FROM d",), ("delete from e",), (None,)], "sql string")
    assert [(r["reads"], r["writes"]) for r in extract.sql_tables(df).collect()] == [(["a", "b"], []), (["d"], ["c"]), ([], ["e"]), ([], [])]


def test_middleware_groups_and_aliases(spark):
    f = spark.createDataFrame
    x = extract.middleware(f([(1, ["web", "throttle:6"])], "route_id int, middleware array<string>"), f([("web", ["auth", "csrf"])], "name string, members array<string>"), f([("auth", "App\\Auth")], "alias string, class string"))
    assert rows(x, "position", "middleware") == [(0, "App\\Auth"), (1, "csrf"), (2, "throttle")]


def test_snippets_and_walk(spark, php, tmp_path):
    s = spark.createDataFrame([(1, 3, 3), (1, 9, 2), (1, 0, 5), (99, 1, 1)], "file_id int, line_start int, line_end int")
    assert {(r["line_start"], r["text"]) for r in extract.snippet(php, s).collect()} == {(3, "namespace App\\Http;"), (9, ""), (0, None)}
    for p in ("app/Models/A.php", "vendor/x/B.php", "public/c.php", "app/skip.log"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("<?php\n")
    got = src.walk(spark, str(tmp_path), ignore=["*.log"])
    assert rows(got, "path", "role") == [("app/Models/A.php", "model")]
    m = spark.createDataFrame([(1, "composer.json", '{"name": "a/b", "require": {"php": "^8"}, "require-dev": {"t": "1"}, "autoload": {"psr-4": {"App\\\\": "app/"}}}'), (2, "x/composer.json", "{")], "file_id int, path string, content string")
    a, b = src.manifest(m).orderBy("file_id").collect()
    assert a["php_constraint"] == "^8" and a["packages"] == {"php": "^8", "t": "1"} and a["psr4"] == {"App\\": "app/"} and b["name"] is None
    p = spark.createDataFrame([("App\\Models\\A",), ("Lib\\A",)], "f string").select(src.psr4_path(F.col("f"), F.lit("App\\"), F.lit("app")).alias("p")).collect()
    assert [r["p"] for r in p] == ["app/Models/A.php", None]


def test_graph_sink_round_trip(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "A")], "node_id string, label string"), spark.createDataFrame([("a", "R", "a")], "src string, rel string, dst string")
    src.write_graph(n, e, str(tmp_path / "g"))
    src.write_graph(spark.createDataFrame([("b", "B")], "node_id string, label string"), e, str(tmp_path / "g"))
    n2, e2 = src.read_graph(spark, str(tmp_path / "g"))
    assert {r["node_id"] for r in n2.collect()} == {"a", "b"} and e2.count() == 1


def test_declared_middleware_and_bindings_of_every_form(frame):
    kernel = "<?php\nclass Kernel {\n protected $middleware = [ \\App\\Trust::class, 'cors' ];\n protected $middlewareGroups = [ 'web' => [ A::class, 'throttle:6' ], 'api' => [ B::class ] ];\n protected $routeMiddleware = [ 'auth' => \\App\\Auth::class ];\n}\n"
    boot = "<?php\n$middleware->append(C::class);\n$middleware->group('extra', [D::class]);\n$middleware->alias(['slow' => E::class]);\n"
    x = rows(extract.middleware_registry(frame([(1, kernel), (2, boot), (3, None)], "file_id int, content string")).select("kind", F.coalesce("name", F.lit("")).alias("name"), F.concat_ws(",", "members").alias("m")), "kind", "name", "m")
    assert x == [("alias", "auth", "App\\Auth"), ("alias", "slow", "E"), ("global", "", "App\\Trust,cors"), ("global", "", "C"), ("group", "api", "B"), ("group", "extra", "D"), ("group", "web", "A,throttle:6")]
    text = "<?php\n$this->app->singleton(Gate::class, RealGate::class);\n$this->app->tag([A::class, B::class], 'reports');\napp()->when(X::class)->needs(Y::class)->give(Z::class);\n"
    b = rows(extract.bindings(frame([(1, text)], "file_id int, content string")), "binding_type", "abstract", "concrete")
    assert b == [("contextual", "Y", "Z"), ("singleton", "Gate", "RealGate"), ("tag", "reports", "A"), ("tag", "reports", "B")]
    l = frame([(1, "app/Listeners/Mail.php", "<?php\n#[Listen(Sold::class)]\nclass Mail {}\n")], "file_id int, path string, content string")
    assert rows(extract.listeners(l), "event", "listener", "source") == [("Sold", "Mail", "attribute")]


def test_schedules_switches_writes_and_procedures(frame):
    text = "<?php\n$schedule->command('a:b')->dailyAt('3:00')->timezone('UTC')->onOneServer();\n// $schedule->job(new J)->cron('* * * * *');\n$schedule->job(K::class)->hourly()->withoutOverlapping();\n"
    s = rows(extract.schedules(frame([(1, text)], "file_id int, content string")).na.fill(""), "task", "frequency", "cron", "disabled", "timezone", "without_overlapping", "on_one_server")
    assert s == [("J", "cron", "* * * * *", True, "", False, False), ("K", "hourly", "", False, "", True, False), ("a:b", "dailyAt", "", False, "UTC", False, True)]
    code = "<?php\nswitch ($x) {\n case 'a':\n  return $this->left;\n case 2: return 'two';\n default: return 1;\n}\n$u->posts()->create([]);\nDB::table($name)->get();\n"
    f = frame([(1, code)], "file_id int, content string")
    assert rows(extract.switch_maps(f), "key", "value") == [("2", '"two"'), ("a", "left")]
    assert rows(extract.db_access(f), "via", "target", "operation") == [("dynamic_table", "$name", "read"), ("relation_write", "posts", "write")]
    p = frame([("r", "p", "CREATE PROCEDURE p(IN a INT, OUT b VARCHAR(20))\nBEGIN SELECT 1 IN (2); END"), ("r", "q", None)], "repo string, name string, body string")
    assert rows(extract.procedure_parameters(p), "position", "mode", "parameter", "type") == [(0, "IN", "a", "INT"), (1, "OUT", "b", "VARCHAR(20)")]


def test_registry_log_and_schema_hashes(spark, frame, tmp_path):
    r = src.registry_update(None, frame([("/a", 1.0, "x"), ("/b", 2.0, "y")], "path string, indexed_at double, version string"))
    t = src.registry_touch(r, "/a", 9)
    assert rows(t, "path", "indexed_at", "version") == [("/a", 9.0, "x"), ("/b", 2.0, "y")] and rows(src.registry_touch(r, "/z", 9), "path") == [("/a",), ("/b",)]
    assert rows(src.registry_remove(t, "/a"), "path") == [("/b",)]
    (tmp_path / "log").write_text("\x1eabc|0\n\na.php\nb/c.php\n\x1edef|60\n\n\x1eghi|120\n\na.php\n")
    assert rows(src.git_log(spark, str(tmp_path / "log")), "commit", "file") == [("abc", "a.php"), ("abc", "b/c.php"), ("ghi", "a.php")]
    c = frame([("t", "a", "int"), ("t", "b", None), ("u", "a", "int")], "table string, column string, type string")
    h = src.schema_hash(c, ["table"])
    changed = src.schema_hash(c.filter("not (table = 't' and column = 'b')"), ["table"])
    assert rows(src.stale_by_schema(h, changed, ["table"]), "table") == [("t",)] and src.stale_by_schema(h, src.schema_hash(c.orderBy("column"), ["table"]), ["table"]).count() == 0
