"""Extraction, naming, search and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions import naming
from codeweft.operators import analytics, extract, quality, search
from codeweft.plans import extract_sql
from codeweft.sources import files as src
from codeweft.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _source(spark, d):
    return table(spark, d, "source_files").select("file_id", "repo", "path", "extension", "content", "size_bytes")


def _php(spark, d):
    return _source(spark, d).filter("extension = '.php'")


_EXPLODED = "select file_id, unnest({0}) as x from source_files where content is not null and {1}"

# ---- scans


@_query(r"""select file_id from source_files where not regexp_matches(path, '(?:^|/)(?:vendor|storage|node_modules|\.git)/') and not starts_with(path, 'bootstrap/cache/') and not starts_with(path, 'public/') and coalesce(size_bytes <= 524288, true)""")
def walked_files(spark, d):
    return _source(spark, d).filter(src.walked(F.col("path"), F.col("size_bytes"))).select("file_id")


_ROLE = """case when ends_with(path, '.blade.php') and starts_with(path, 'resources/views/') then 'blade' when starts_with(path, 'app/Models/') then 'model' when starts_with(path, 'app/Http/Controllers/') then 'controller'
  when starts_with(path, 'app/Http/Middleware/') then 'middleware' when starts_with(path, 'app/Jobs/') then 'job' when starts_with(path, 'app/Events/') then 'event' when starts_with(path, 'app/Listeners/') then 'listener'
  when starts_with(path, 'app/Policies/') then 'policy' when starts_with(path, 'app/Http/Requests/') then 'request' when starts_with(path, 'app/Http/Resources/') then 'resource' when starts_with(path, 'app/Notifications/') then 'notification'
  when starts_with(path, 'app/Observers/') then 'observer' when starts_with(path, 'app/Console/Commands/') then 'command' when starts_with(path, 'app/Providers/') then 'provider' when starts_with(path, 'database/factories/') then 'factory'
  when starts_with(path, 'database/seeders/') then 'seeder' when starts_with(path, 'database/migrations/') then 'migration' when starts_with(path, 'routes/') then 'route_file'
  when ends_with(path, '.php') and strlen(content) < 65536 and (contains(content, 'extends Model') or contains(content, 'extends Authenticatable')) then 'model' else 'php' end"""


@_query(f"select role, count(*) as n from (select {_ROLE} as role from source_files) group by 1")
def file_roles(spark, d):
    return _source(spark, d).groupBy(naming.file_role(F.col("path"), F.col("content")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"""select file_id, length(content) - length(replace(content, chr(10), '')) + case when content <> '' and not ends_with(content, chr(10)) then 1 else 0 end as n_lines, length(content) as n_chars from source_files""")
def line_stats(spark, d):
    return src.line_stats(_source(spark, d))


@_query("""with p as (select repo, string_split(path, '/') as s from source_files), f as (select repo, array_to_string(s[1:i], '/') as folder from p, lateral (select unnest(range(1, len(s))) as i) where len(s) > 1)
  select repo, folder, case when contains(folder, '/') then regexp_replace(folder, '/[^/]*$', '') else '' end as parent, count(*) as n_files from f group by 1, 2, 3""")
def folders(spark, d):
    return src.folders(_source(spark, d))


def manifests(spark, d):
    return src.manifest(_source(spark, d)).select("file_id", "name", "php_constraint", F.size("packages").alias("n_packages"))


QUERIES["manifests"] = manifests


# ---- extraction


@_query(r"""with m as (select file_id, unnest(list_zip(regexp_extract_all(content, '(?m)^use\s+([A-Za-z_\\][\w\\]*)(?:\s+as\s+(\w+))?\s*;', 1), regexp_extract_all(content, '(?m)^use\s+([A-Za-z_\\][\w\\]*)(?:\s+as\s+(\w+))?\s*;', 2))) as x from source_files where extension = '.php' and content is not null)
  select file_id, regexp_replace(x[1], '^\\', '') as fqn, coalesce(nullif(x[2], ''), list_extract(string_split(x[1], '\'), -1)) as alias from m""")
def imports(spark, d):
    return extract.imports(_php(spark, d))


@_query(r"""with m as (select file_id, unnest(list_zip(regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 1), regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 2))) as x from source_files where extension = '.php' and content is not null)
  select x[1] as kind, x[2] as key, count(*) as n, count(distinct file_id) as n_files from m group by 1, 2""")
def config_usage(spark, d):
    return extract.config_uses(_php(spark, d)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


@_query(r"""with c as (select file_id, regexp_extract(path, '(\w+)\.php$', 1) as f, content from source_files where regexp_matches(path, '^config/\w+\.php$') and content is not null)
  select file_id, f || '.' || k as key from (select file_id, f, unnest(regexp_extract_all(content, '(?m)^    ''(\w+)''\s*=>', 1)) as k from c)""")
def config_keys(spark, d):
    return extract.config_keys(_source(spark, d))


@_query(r"""with b as (select file_id, regexp_replace(content, '(?s)\{\{--.*?--\}\}', '', 'g') as t from source_files where extension = '.blade.php' and content is not null)
  select distinct file_id, rel, target from (select file_id, 'EXTENDS_TEMPLATE' as rel, unnest(regexp_extract_all(t, '@extends\(\s*''([^'']+)''', 1)) as target from b
  union all select file_id, 'INCLUDES_TEMPLATE', unnest(regexp_extract_all(t, '@(?:include(?:If)?|each)\(\s*''([^'']+)''', 1)) from b union all select file_id, 'HAS_COMPONENT', unnest(regexp_extract_all(t, '<x-([\w.:-]+)', 1)) from b)""")
def template_graph(spark, d):
    return extract.templates(_source(spark, d))


@_query(r"""with m as (select file_id, regexp_extract_all(content, 'Route::(get|post|put|patch|delete|options|any)\(\s*''([^'']*)''\s*,\s*\[\s*([\w\\]+)::class\s*,\s*''(\w+)''\s*\]', 1) as v,
    regexp_extract_all(content, 'Route::(get|post|put|patch|delete|options|any)\(\s*''([^'']*)''\s*,\s*\[\s*([\w\\]+)::class\s*,\s*''(\w+)''\s*\]', 2) as u,
    regexp_extract_all(content, 'Route::(get|post|put|patch|delete|options|any)\(\s*''([^'']*)''\s*,\s*\[\s*([\w\\]+)::class\s*,\s*''(\w+)''\s*\]', 3) as c,
    regexp_extract_all(content, 'Route::(get|post|put|patch|delete|options|any)\(\s*''([^'']*)''\s*,\s*\[\s*([\w\\]+)::class\s*,\s*''(\w+)''\s*\]', 4) as a from source_files where extension = '.php' and content is not null)
  select file_id, upper(x[1]) as http_method, x[2] as uri, x[3] as controller, x[4] as action from (select file_id, unnest(list_zip(v, u, c, a)) as x from m)""")
def routes(spark, d):
    return extract.routes(_php(spark, d)).select("file_id", "http_method", "uri", naming.short_name(F.col("controller")).alias("controller"), "action")


@_query(r"""with m as (select file_id, unnest(regexp_extract_all(content, 'Route::(?:get|post|put|patch|delete|options|any)\(\s*''([^'']*)''', 1)) as uri from source_files where extension = '.php' and content is not null),
  s as (select [p for p in string_split(lower(uri), '/') if p <> '' and not starts_with(p, '{') and p not in ('api','v1','v2','v3','v4','web','admin','dashboard','app','index','list','detail','show','create','store','edit','update','delete','destroy')] as p from m)
  select coalesce(replace(p[1], '-', '_'), 'general') as slug, count(*) as n from s group by 1""")
def feature_slugs(spark, d):
    return extract.routes(_php(spark, d)).groupBy(naming.feature_slug(F.col("uri")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"""with c as (select file_id, replace(content, '(', '( ') as t from source_files where extension = '.php' and content is not null),
  m as (select file_id, 'event' as f, unnest(regexp_extract_all(t, '\bevent\s*\(\s*new\s+([\w\\]+)\s*\(', 1)) as x from c union all select file_id, 'event', unnest(regexp_extract_all(t, 'Event::dispatch\s*\(\s*new\s+([\w\\]+)\s*\(', 1)) from c
    union all select file_id, 'new', unnest(regexp_extract_all(t, '(?:^|[^:])dispatch(?:If|Now|AfterResponse|Sync)?\s*\(\s*(?:[^,;]+,\s*)?new\s+([\w\\]+)\s*\(', 1)) from c union all select file_id, 'self', unnest(regexp_extract_all(t, '([\w\\]+)::dispatch(?:If|Now|AfterResponse|Sync)?\s*\(', 1)) from c),
  s as (select file_id, f, list_extract(string_split(x, '\'), -1) as target from m)
  select target, case when f = 'event' or ends_with(target, 'Event') or (f = 'self' and ends_with(target, 'Notification')) then 'event' else 'job' end as dispatch_type, count(*) as n from s
  where not (f = 'self' and lower(target) in ('event', 'bus', 'queue', 'job', 'mail', 'notification', 'dispatch')) group by 1, 2""")
def dispatch_targets(spark, d):
    return extract.dispatches(_php(spark, d)).groupBy("target", "dispatch_type").agg(F.count(F.lit(1)).alias("n"))


@_query("""select child, rel, parent, count(*) as n from (select fqn as child, 'EXTENDS_CLASS' as rel, extends as parent from parsed_classes union all select fqn, 'IMPLEMENTS_INTERFACE', unnest(implements) from parsed_classes
  union all select fqn, 'USES_TRAIT', unnest(traits) from parsed_classes) where trim(parent) <> '' group by 1, 2, 3""")
def heritage(spark, d):
    return extract.heritage(table(spark, d, "parsed_classes")).groupBy("child", "rel", "parent").agg(F.count(F.lit(1)).alias("n"))


@_query(r"""with p as (select method_id, unnest(string_split_regex(regexp_replace(coalesce(return_type, ''), '[?()\s]', '', 'g'), '[|&]')) as t, 'return' as role from methods
  union all select method_id, unnest(string_split_regex(regexp_replace(q, '[?()\s]', '', 'g'), '[|&]')), 'param' from (select method_id, unnest(cast(json(param_types) as varchar[])) as q from methods where json_valid(param_types)))
  select distinct method_id, regexp_replace(t, '^\\', '') as type, role from p where t <> '' and t not in ('int','integer','float','double','string','bool','boolean','null','void','never','array','callable','iterable','mixed','object','resource','self','static','parent','$this','true','false')""")
def type_uses(spark, d):
    return extract.type_uses(table(spark, d, "methods")).select("method_id", "type", "role").distinct()


def migration_columns(spark, d):
    return extract.migration_columns(_source(spark, d))


def db_access(spark, d):
    return extract.db_access(_php(spark, d)).groupBy("via", "operation", "target").agg(F.count(F.lit(1)).alias("n"))


def injections(spark, d):
    return extract.injections(_php(spark, d)).groupBy("injection", "type").agg(F.count(F.lit(1)).alias("n"))


def model_facts(spark, d):
    return extract.model_facts(_php(spark, d)).drop("casts")


def contracts(spark, d):
    return extract.contracts(_php(spark, d)).groupBy("kind", "subject").agg(F.count(F.lit(1)).alias("n"))


def guard_conditions(spark, d):
    php = _php(spark, d)
    return extract.guards(php, extract.dispatches(php))


def switch_maps(spark, d):
    return extract.switch_maps(_php(spark, d)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


for _f in (migration_columns, db_access, injections, model_facts, contracts, guard_conditions, switch_maps):
    QUERIES[_f.__name__] = _f


# ---- names


@_query(r"""with n as (select distinct name from parsed_classes where name is not null),
  s as (select name, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) as snake from n)
  select name, snake, case when ends_with(snake, 'y') and not ends_with(snake, 'ey') then regexp_replace(snake, 'y$', 'ies') when regexp_matches(snake, '(?:s|x|z|ch|sh)$') then snake || 'es' else snake || 's' end as table_name,
  [t for t in string_split(lower(trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') if length(t) >= 3] as tokens from s""")
def name_forms(spark, d):
    n = table(spark, d, "parsed_classes").select("name").filter("name is not null").distinct()
    return n.select("name", naming.snake(F.col("name")).alias("snake"), naming.table_of_class(F.col("name")).alias("table_name"), F.filter(F.split(F.lower(F.trim(F.regexp_replace(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "))), " "), lambda x: F.length(x) >= 3).alias("tokens"))


@_query(r"""select node_id, substr(sha1(concat_ws('|', fqn, label)), 1, 10) as id from (select distinct node_id, fqn, label from search_results)""")
def stable_ids(spark, d):
    return table(spark, d, "search_results").select("node_id", "fqn", "label").distinct().select("node_id", naming.stable_id(F.col("fqn"), F.col("label")).alias("id"))


@_query("""select method_id, case when name in ('hasOne', 'hasMany', 'belongsTo', 'belongsToMany', 'hasOneThrough', 'hasManyThrough', 'morphOne', 'morphMany', 'morphTo', 'morphToMany', 'morphedByMany') then 'relationship'
  when regexp_matches(name, '^scope[A-Z]') then 'scope' when starts_with(name, 'get') and ends_with(name, 'Attribute') then 'accessor' when starts_with(name, 'set') and ends_with(name, 'Attribute') then 'mutator'
  when name in ('boot', 'booted') then 'boot' when name = 'register' then 'register' when name = 'handle' then 'handle' end as tag from methods""")
def method_tags(spark, d):
    return table(spark, d, "methods").select("method_id", naming.method_tag(F.col("name")).alias("tag"))


@_query("""with t as (select repo, lower(name) as k, source from db_tables where name is not null), b as (select repo, k, min_by(source, (case source when 'live_db' then 0 when 'migration' then 1 else 2 end, source)) as source from t group by 1, 2)
  select model_id, m.repo, lower(db_table) as table_key, coalesce(b.source, 'stub') as source from eloquent_models m left join b on b.repo = m.repo and b.k = lower(m.db_table)""")
def model_tables(spark, d):
    m = table(spark, d, "eloquent_models").select("model_id", "repo", F.lower("db_table").alias("table_key"))
    t = table(spark, d, "db_tables").filter("name is not null").select("repo", F.lower("name").alias("table_key"), "source")
    return analytics.model_tables(m, t)


# ---- search


_BM25 = """with t as (select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '\\s+') if x <> ''] as w from documents),
  tot as (select count(*) as docs, avg(len(w)) as avgdl from t), v as (select term, count(*) as df from (select doc_id, unnest(list_distinct(w)) as term from t) group by 1),
  mean as (select avg(ln(docs - df + 0.5) - ln(df + 0.5)) as m from v, tot), q(term) as (values ('invoice'), ('template'), ('policy')),
  qi as (select q.term, coalesce(v.df, 0) as df, case when v.df is null then 0.0 when ln(docs - v.df + 0.5) - ln(v.df + 0.5) < 0 then 0.25 * m else ln(docs - v.df + 0.5) - ln(v.df + 0.5) end as idf from q left join v on v.term = q.term, tot, mean),
  s as (select doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) as raw from (select doc_id, len(w) as n, qi.idf, len([x for x in w if x = qi.term]) as tf from t, qi), tot group by 1)"""


@_query(_BM25 + " select doc_id, round(raw / (select max(raw) from s), 6) as score from s where raw > 0")
def bm25_scores(spark, d):
    return search.bm25(table(spark, d, "documents"), "invoice template policy").select("doc_id", F.round("score", 6).alias("score"))


@_query("""with q as (select embedding as e from embeddings order by vec_id limit 1),
  s as (select vec_id, list_dot_product(embedding::double[], e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[])) + 1e-10) as score from embeddings, q)
  select vec_id, round(score, 6) as score from s where score > 0""")
def cosine_scores(spark, d):
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()["embedding"]
    return search.cosine(v, q).select("vec_id", F.round("score", 6).alias("score"))


@_query("""select p_partkey, round(score, 6) as score from (select p_partkey, 100.0 * (1 - levenshtein(lower(coalesce(p_name, '')), 'red widget') / greatest(length(coalesce(p_name, '')), 10)) as score from part) where score >= 60 order by score desc, p_partkey limit 50""")
def fuzzy_names(spark, d):
    return search.fuzzy(table(spark, d, "part"), "red widget", "p_partkey", "p_name").select("p_partkey", F.round("score", 6).alias("score"))


@_query(_BM25 + """, hb as (select doc_id, round(raw / (select max(raw) from s), 6) as x from s where raw > 0),
  he as (select embedding::double[] as q from embeddings order by vec_id limit 1),
  hv as (select vec_id as doc_id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q)) + 1e-10), 6) as x from embeddings, he),
  hf as (select doc_id, round(100.0 * (1 - levenshtein(lower(coalesce(source, '')), 'invoice template policy') / greatest(length(coalesce(source, '')), 23)), 6) as x from documents order by 2 desc, 1 limit 50),
  hp as (select doc_id, 0.4 / (60 + row_number() over (order by x desc, doc_id)) as y from hb union all select doc_id, 0.4 / (60 + row_number() over (order by x desc, doc_id)) from hv where x > 0 union all select doc_id, 0.2 / (60 + row_number() over (order by x desc, doc_id)) from hf)
  select doc_id, round(y * case when contains(source, 'vendor/') then 0.1 when contains(lower(source), 'test') then 0.5 when source <> '' then 1.2 else 1.0 end, 8) as score from (select doc_id, sum(y) as y from hp group by 1) join documents using (doc_id) order by 2 desc, 1 limit 50""")
def hybrid_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = search.cosine(vectors, vectors.orderBy("doc_id").select("embedding").first()["embedding"], "doc_id")
    lists = {"bm25": search.bm25(docs, "invoice template policy"), "vector": near, "fuzzy": search.fuzzy(docs, "invoice template policy", "doc_id", "source", 0.0)}
    lists = {n: x.withColumn("score", F.round("score", 6)) for n, x in lists.items()}
    return search.page(search.boosted(search.rrf(lists, "doc_id").join(docs.select("doc_id", "source"), "doc_id"), F.col("source")), "doc_id", 50).select("doc_id", F.round("score", 8).alias("score"))


_HIT = "case when isnan({0}) or {0} = 0 then null else {0} end"


@_query(f"""with h as (select query_id, node_id, max({_HIT.format('bm25_score')}) as b, max({_HIT.format('vector_score')}) as v, max({_HIT.format('fuzzy_score')}) as f from search_results where query_id is not null and node_id is not null group by 1, 2),
  r as (select query_id, node_id, row_number() over (partition by query_id order by b desc, node_id) as k from h where b is not null union all select query_id, node_id, row_number() over (partition by query_id order by v desc, node_id) from h where v is not null
    union all select query_id, node_id, row_number() over (partition by query_id order by f desc, node_id) from h where f is not null)
  select query_id, node_id, round(sum(1.0 / (60 + k)), 8) as score from r group by 1, 2""")
def rrf_merge(spark, d):
    s = table(spark, d, "search_results").filter("query_id is not null and node_id is not null")
    hit = lambda c: F.max(F.when(~F.isnan(c) & (F.col(c) != 0), F.col(c))).alias("score")
    lists = {c: s.groupBy("query_id", "node_id").agg(hit(c)).filter("score is not null") for c in ("bm25_score", "vector_score", "fuzzy_score")}
    return search.rrf(lists, "node_id", by=["query_id"]).select("query_id", "node_id", F.round("score", 8).alias("score"))


@_query("""with v as (select vec_id, embedding::double[] as e from embeddings), q as (select * from v where vec_id % 20 = 0),
  s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e) / ((sqrt(list_dot_product(q.e, q.e)) + 1e-10) * (sqrt(list_dot_product(v.e, v.e)) + 1e-10)), 9) as score from q, v where q.vec_id <> v.vec_id)
  select query_id, vec_id, rank from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s) where rank <= 10""")
def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return search.exact_neighbours(v, v.filter("vec_id % 20 = 0")).select("query_id", "vec_id", "rank")


# ---- quality


@_query("select cast(event_type as varchar) as value, count(*) as n from events group by 1 order by 1 limit 100")
def value_distribution(spark, d):
    return quality.value_distribution(table(spark, d, "events"), "event_type")


@_query("""with c as (select cast(event_type as varchar) as value, count(*) as n from events where event_type is not null group by 1 order by 2 desc, 1 limit 4), s as (select count(*) > 3 as overflow from c) select value, n, overflow from c, s order by n desc, value limit 3""")
def value_sample(spark, d):
    return quality.value_sample(table(spark, d, "events"), "event_type", 3)


@_query(r"""with c as (select lang as value, regexp_replace(lower(trim(lang)), '[\s_-]+', '', 'g') as normal, count(*) as n from documents where lang is not null group by 1, 2), s as (select count(*) as k, sum(n) as r from c)
  select normal, list_sort(list(value)) as spellings, cast(sum(n) as bigint) as n from c, s where k <= 30 and r >= 10 group by 1 having count(*) > 1""")
def enum_near_duplicates(spark, d):
    return quality.enum_near_duplicates(table(spark, d, "documents"), "lang")


@_query("""select 'db_table' as "column", count(*) filter (where db_table is null) as n_null, count(*) filter (where trim(db_table) = '') as n_empty, count(*) as n_rows from eloquent_models
  having count(*) filter (where db_table is null) > 0 and count(*) filter (where trim(db_table) = '') > 0 and count(*) >= 10""")
def mixed_empty(spark, d):
    return quality.mixed_empty(table(spark, d, "eloquent_models"), "db_table")


@_query("""select 'o_orderstatus' as "column", count(*) as n_rows, count(distinct lower(trim(o_orderstatus))) as n_distinct, (select list_sort(list(distinct lower(trim(o_orderstatus)))) from orders) as "values" from orders having bool_or(lower(trim(o_orderstatus)) not in ('0', '1', 'true', 'false'))""")
def boolean_drift(spark, d):
    return quality.boolean_drift(table(spark, d, "orders"), "o_orderstatus")


@_query("select upper(coalesce(event_type, 'unknown')) as level, count(*) as n from events group by 1")
def log_stats(spark, d):
    return quality.log_stats(table(spark, d, "events"), "event_type")


def quality_report(spark, d):
    return quality.quality_report(table(spark, d, "documents"), "documents")


QUERIES["quality_report"] = quality_report


def discriminators(spark, d):
    c = extract.migration_columns(_source(spark, d)).select("table", "column", "type").distinct()
    return c.select("table", "column", quality.discriminator(F.col("column"), F.col("type")).alias("is_discriminator")).distinct()


QUERIES["discriminators"] = discriminators
SQL.update(extract_sql.SQL)
