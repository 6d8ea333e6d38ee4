"""The SQL of the tools, over the graph in SQL."""

from __future__ import annotations

from codeweft.plans.code_queries import _KEY, _TABLE
from codeweft.plans.graph_sql import _PLURAL, _ROLE, _SNAKE, with_parts

_HANDLED = "(select src, min(dst) as dst from handler group by 1)"
_WORD = """coalesce(list_extract([replace(p, '-', '_') for p in string_split(lower(uri), '/') if p <> '' and not starts_with(p, '{') and p not in ('api', 'v1', 'v2', 'v3', 'v4', 'web', 'admin', 'dashboard',
  'app', 'index', 'list', 'detail', 'show', 'create', 'store', 'edit', 'update', 'delete', 'destroy')], 1), 'general')"""
_CALLED_BY_FRAMEWORK = """('handle', 'boot', 'register', 'up', 'down', 'run', 'definition', 'schedule', 'broadcastOn', 'broadcastWith', 'broadcastAs', 'via', 'toMail', 'toArray', 'build', '__construct', '__call', '__callStatic', '__get',
  '__set', '__toString', '__invoke', '__destruct', '__clone', '__sleep', '__wakeup', '__serialize', '__unserialize', '__isset', '__unset', '__debugInfo')"""
_SOURCE = r"""(select m.node, m.name, m.file_path, s.role, l[m.line_start:(case when m.line_end >= m.line_start then m.line_end else len(l) end)] as src
  from meth m join (select file_id, string_split_regex(content, '\r\n|\n|\r') as l from php where content is not null) f using (file_id) left join sym s on s.key = m.class_key where m.line_start >= 1)"""
_RISKS = rf"""select node as method, line, risk, severity from (
    select node, i as line, case when eager then 'missing_eager_load' else 'n_plus_one' end as risk, case when eager then 'MEDIUM' else 'HIGH' end as severity from (select node, i, regexp_matches(array_to_string(src, chr(10)), '->with\s*\(|\$with\s*=') as eager,
        regexp_extract(src[i], 'foreach\s*\(\s*\$\w+\s+as\s+(?:\$\w+\s*=>\s*)?\$(\w+)\s*\)', 1) as v, regexp_extract(array_to_string(src[i + 1:i + 20], chr(10)), '\$(\w+)\s*->\s*\w+\s*->', 1) as first
        from (select *, unnest(range(1, len(src) + 1)) as i from scanned)) where v <> '' and v = first
    union all select node, i, 'raw_query_bypass', 'MEDIUM' from (select node, i, unnest(regexp_extract_all(src[i], '\bDB\s*::\s*(?:select|statement)\s*\(')) from (select *, unnest(range(1, len(src) + 1)) as i from scanned))
    union all select node, min(i), 'repeated_count', 'MEDIUM' from (select node, i, unnest(regexp_extract_all(src[i], '->\s*count\s*\(\s*\)')) from (select *, unnest(range(1, len(src) + 1)) as i from scanned)) group by node having count(*) >= 2)"""
_SCANNED = f", scanned as (select * from {_SOURCE} where role in ('controller', 'service', 'repository', 'model') and not contains(lower(coalesce(file_path, '')), '/tests/'))"
_RACES = rf"""select distinct node as method, 'STATUS_GATE' as pattern, c as columns from (select node, code, unnest(regexp_extract_all(code, 'if\s*\(\s*\$(\w+)->\s*(\w+)\s*(?:===|==)\s*[''"]\w+[''"]', 1)) as v, unnest(regexp_extract_all(code, 'if\s*\(\s*\$(\w+)->\s*(\w+)\s*(?:===|==)\s*[''"]\w+[''"]', 2)) as c from judged)
    where regexp_matches(c, '(?:status|state|stage)$') and v <> 'request' and regexp_matches(code, '\$' || v || '->\s*' || c || '\s*=\s*[''"]') and regexp_matches(code, '\$' || v || '->\s*save\s*\(')
  union select distinct node, 'ELOQUENT_PROPERTY', c from (select node, code, i, l, regexp_extract(l[i], '\$(\w+)->(\w+)\s*=', 1) as v, regexp_extract(l[i], '\$(\w+)->(\w+)\s*=', 2) as c, regexp_extract(l[i], '\$\w+->\w+\s*=(.*)', 1) as rhs from (select *, unnest(range(1, len(l) + 1)) as i from (select *, string_split(code, chr(10)) as l from judged)))
    where v <> '' and v not in ('request', 'response', 'this', 'data', 'input', 'params') and c not in ('id', 'created_at', 'updated_at', 'deleted_at') and regexp_matches(rhs, '\$' || v || '->' || c || '(?:\s|[-+*/;]|$)') and regexp_matches(array_to_string(l[i:i + 9], chr(10)), '\$' || v || '->\s*save\s*\(')
      and not regexp_matches(code, '(?:decrement|increment)\(\s*[''"]' || c || '[''"]')
  union select node, 'CAPACITY_CHECK', 'count/capacity' from judged where regexp_matches(code, '(?s)(?:->count\(\)|->sum\([^)]*\))\s*;\s*\n[^;]*if\s*\(\s*\$\w+\s*(?:<|<=|>=|>)\s*\$?\w+') and regexp_matches(code, '::create\(|->insert\(')"""
_JUDGED = rf""", judged as (select * from (select node, name, regexp_replace(regexp_replace(array_to_string(src, chr(10)), '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g') as code from {_SOURCE} where role in ('model', 'controller', 'service', 'job') and not contains(coalesce(file_path, ''), '/tests/')
    and not regexp_matches(name, '(?i)(?:avg|trend|insight|report|stats|analytics|export|download|index$|list$|show$|get[A-Z])'))
  where not regexp_matches(lower(code), 'db::transaction|lockforupdate|sharedlock|cache::lock|->lock\(') and not (contains(lower(code), '$request->') and not contains(lower(code), '->save()')))"""
_PREFIX = "case when starts_with(path, 'app/') and contains(substr(path, 5), '/') then string_split(path, '/')[2] when contains(path, '/') then string_split(path, '/')[1] else '.' end"

SQL = {
    "call_graph": with_parts("select call_type, case when method then 'method' else 'class' end as target_kind, confidence, count(*) as n from called group by 1, 2, 3"),
    "call_targets": with_parts("select distinct src, dst as target, line from called"),
    "query_risks": with_parts(_SCANNED + " " + _RISKS),
    "race_conditions": with_parts(_JUDGED + " " + _RACES),
    "tool_risks": with_parts(_SCANNED + _JUDGED + f" select method, kind, detail, severity, count(*) as n from (select method, 'query' as kind, risk as detail, severity from ({_RISKS}) union all select method, 'race', pattern, 'MEDIUM' from ({_RACES})) group by 1, 2, 3, 4"),
    "tool_context": with_parts(
        """select node_id, direction, rel, other, coalesce(s.label, case when m.node is not null then 'Method' when f.node is not null then 'File' end) as other_label, coalesce(s.name, m.name, list_extract(string_split(f.path, '/'), -1)) as other_name, n from (
      select node_id, direction, rel, other, count(*) as n from (select case d when 'out' then src else dst end as node_id, d as direction, rel, case d when 'out' then dst else src end as other
        from (select src, 'DEFINES' as rel, dst from deff union all select src, 'DEFINES', dst from defm union all select src, rel, dst from heir union all select src, 'CALLS', dst from called union all select src, 'USES_TYPE', dst from tuse), (values ('out'), ('in')) v(d)) where node_id in (select node from sym) group by 1, 2, 3, 4) x
      left join sym s on s.node = other left join meth m on m.node = other left join fileid f on f.node = other"""
    ),
    "tool_impact": with_parts(
        """, seed as (select node from sym union select node from meth union select node from route union select node from live), step as (select dst as a, src as b from called union select dst, src from tuse union select dst, src from heir union select dst, src from handler union select src, dst from called union select src, dst from qtab),
      w as (select node as root, node, 0 as depth from seed union select w.root, e.b, w.depth + 1 from w join step e on e.a = w.node where w.depth < 3)
      select x.root, x.node, n.label, n.name, x.depth from (select root, node, min(depth) as depth from w group by 1, 2 having min(depth) > 0) x
      join (select node, label, name from sym union all select node, 'Method', name from meth union all select distinct node, 'Route', verb || ' ' || uri from route union all select node, 'DatabaseTable', name from live) n on n.node = x.node""",
        recursive=True,
    ),
    "tool_dead_methods": with_parts(
        f"""select m.node as node_id, m.name, m.file_path from meth m left join sym s on s.key = m.class_key where m.node not in (select dst from called union all select dst from handler) and m.name not in (select action from route)
      and not coalesce(s.label = 'Trait_' or s.role in ('policy', 'observer', 'request', 'resource'), false) and m.node not in (select m1.node from meth m1 join sym c on c.key = m1.class_key join heir h on h.src = c.node and h.rel = 'EXTENDS_CLASS' join sym p on p.node = h.dst join meth m2 on m2.class_key = p.key and m2.name = m1.name)
      and m.name not in {_CALLED_BY_FRAMEWORK} and not regexp_matches(m.name, '^scope[A-Z]|^[gs]et[A-Z].*Attribute$') and not coalesce(contains(m.file_path, '/vendor/') or contains(m.file_path, '/legacy/'), false)"""
    ),
    "tool_table_access": with_parts(
        """select l.node as "table", count(*) filter (where op = 'read') as n_reads, count(*) filter (where op = 'write') as n_writes, count(*) filter (where op = 'delete') as n_deletes, count(distinct src) filter (where op = 'read') as readers,
      count(distinct src) filter (where op <> 'read') as writers, count(distinct src) filter (where op = 'read') > 0 and count(distinct src) filter (where op <> 'read') > 0 as conflict from qtab q join live l on l.node = q.dst group by 1"""
    ),
    "tool_write_impact": with_parts("""select distinct l.node as "table", q.src as method, null::varchar as target, null::varchar as target_name from qtab q join live l on l.node = q.dst where op <> 'read'"""),
    "tool_settings": r"""with u as (select repo, path, unnest(list_zip(regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 1), regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 2))) as x from source_files where extension = '.php' and content is not null),
      k as (select distinct repo, regexp_extract(path, '(\w+)\.php$', 1) || '.' || n as key from (select repo, path, unnest(regexp_extract_all(content, '(?m)^    ''(\w+)''\s*=>', 1)) as n from source_files where regexp_matches(path, '^config/\w+\.php$') and content is not null))
      select key, kind, n_files, n_sites, kind = 'env' or exists (select 1 from k where k.repo is not distinct from g.repo and k.key = g.key) as declared from (select repo, x[2] as key, x[1] as kind, count(distinct path) as n_files, count(*) as n_sites from u group by 1, 2, 3) g""",
    "tool_changed_symbols": with_parts("""select n.node as node_id, n.label, 'late' as change from (select node, label, file_path from sym union all select node, 'Method', file_path from meth) n join (select distinct path from source_files where loaded_at > committed_at + interval 1 day) f on f.path = n.file_path"""),
    "tool_unused_classes": with_parts("select node as node_id, name from sym where node not in (select dst from heir) and node not in (select dst from tuse)"),
    "tool_routes": with_parts(f"select r.node as node_id, r.repo, verb as http_method, uri, controller, action, h.dst as handler from route r left join {_HANDLED} h on h.src = r.node"),
    "tool_api_surface": with_parts(f"select r.repo, {_WORD} as feature, verb as http_method, count(*) as n_routes, 0 as n_guarded, count(h.dst) as n_handled from route r left join {_HANDLED} h on h.src = r.node group by 1, 2, 3"),
    "tool_models": with_parts(
        f"""select m.node_id, m.repo, m.name, m.fqn, m.t as table_name, l.node as table_node, m.soft_deletes, m.timestamps, coalesce(json_array_length(case when json_valid(fillable) then fillable end), 0) as n_fillable, coalesce(len(json_keys(case when json_valid(casts) and json_type(casts) = 'OBJECT' then casts end)), 0) as n_casts
      from (select *, coalesce({_TABLE.format('db_table')}, {_PLURAL.format(_SNAKE.format('name'))}) as t, row_number() over (partition by node_id order by parsed_at desc nulls last, model_id desc) as rn from eloquent_models where node_id is not null) m left join live l on l.repo = m.repo and l.table_key = m.t where rn = 1"""
    ),
    "tool_events": with_parts(
        r"""select s.node as node_id, s.repo, s.name, s.role as kind, 0 as n_dispatchers, coalesce(l.n, 0) as n_listeners from sym s left join (select repo, list_extract(string_split(e, '\'), -1) as name, count(distinct regexp_extract(path, '(\w+)\.php$', 1)) as n from (select repo, path, unnest(regexp_extract_all(content, 'function\s+handle\(\s*\\?([A-Z][\w\\]*)\s+\$', 1)) as e
      from php where contains(path, '/Listeners/') and content is not null) group by 1, 2) l on l.repo = s.repo and l.name = s.name where s.role in ('event', 'job')"""
    ),
    "tool_schema": with_parts("""select l.repo, l.table_key as table_name, l.connection, l.source, coalesce(c.columns, []) as columns from live l left join (select repo, tab, list_sort(list(distinct "column")) as columns from col group by 1, 2) c on c.repo = l.repo and c.tab = l.table_key"""),
    "tool_db_context": with_parts(
        """select l.node as node_id, l.repo, l.table_key as name, coalesce(c.n, 0) as n_columns, coalesce(m.n, 0) as n_models, coalesce(q.r, 0) as n_readers, coalesce(q.w, 0) as n_writers from live l
      left join (select repo, tab, count(distinct "column") as n from col group by 1, 2) c on c.repo = l.repo and c.tab = l.table_key left join (select tab, count(distinct node) as n from modeltab group by 1) m on m.tab = l.node
      left join (select dst, count(distinct src) filter (where op = 'read') as r, count(distinct src) filter (where op <> 'read') as w from qtab group by 1) q on q.dst = l.node"""
    ),
    "tool_connection_map": with_parts("select l.repo, coalesce(l.connection, 'default') as connection, count(distinct l.node) as n_tables, count(distinct m.node) as n_models, count(distinct q.src) as n_methods from live l left join modeltab m on m.tab = l.node left join qtab q on q.dst = l.node group by 1, 2"),
    "tool_explain": with_parts(
        """select s.node as node_id, s.label, coalesce(a.n, 0) as n_methods, coalesce(b.n, 0) as n_parents, coalesce(c.n, 0) as n_children, coalesce(u.n, 0) as n_users from sym s left join (select src, count(distinct dst) as n from defm group by 1) a on a.src = s.node
      left join (select src, count(distinct dst) as n from heir group by 1) b on b.src = s.node left join (select dst, count(distinct src) as n from heir group by 1) c on c.dst = s.node left join (select dst, count(distinct src) as n from tuse group by 1) u on u.dst = s.node"""
    ),
    "tool_list_repos": with_parts(
        """select f.repo, f.n_files, f.n_lines, coalesce(s.n, 0) as n_symbols, coalesce(m.n, 0) as n_methods, coalesce(e.n, 0) as n_models, coalesce(t.n, 0) as n_tables from (select repo, count(*) as n_files, cast(coalesce(sum(line_count), 0) as bigint) as n_lines from source_files group by 1) f
      left join (select repo, count(*) as n from sym group by 1) s using (repo) left join (select repo, count(*) as n from meth group by 1) m using (repo)
      left join (select repo, count(*) as n from (select *, row_number() over (partition by node_id order by parsed_at desc nulls last, model_id desc) as rn from eloquent_models where node_id is not null) where rn = 1 group by 1) e using (repo) left join (select repo, count(*) as n from live group by 1) t using (repo)"""
    ),
    "tool_map": f"select repo, {_PREFIX} as layer, role, count(*) as n_files from (select repo, path, coalesce(laravel_role, case when ends_with(path, '.blade.php') and starts_with(path, 'resources/views/') then 'blade' when {_ROLE.format(p='path')} <> 'php' then {_ROLE.format(p='path')} "
    "when ends_with(path, '.php') and strlen(content) < 65536 and (contains(content, 'extends Model') or contains(content, 'extends Authenticatable')) then 'model' else 'php' end) as role from source_files) group by 1, 2, 3",
    "tool_resolve_column": with_parts(
        f"""select distinct c.repo, c.tab as table_name, c."column", c.type, c.references_table, c."column" like '%\\_type' escape '\\' or c."column" like '%\\_status' escape '\\' or c."column" like '%\\_state' escape '\\' or c."column" like '%\\_kind' escape '\\' or c."column" like '%\\_mode' escape '\\' or c."column" like '%\\_flag' escape '\\'
        or starts_with(c."column", 'is_') or starts_with(c."column", 'has_') or regexp_matches(c.type, 'tinyint|smallint|enum') as is_discriminator, coalesce(m.n, 0) as n_models from (select *, null::varchar as references_table from col) c
      left join (select repo, t, count(distinct node_id) as n from (select repo, node_id, coalesce({_TABLE.format('db_table')}, {_PLURAL.format(_SNAKE.format('name'))}) as t, row_number() over (partition by node_id order by parsed_at desc nulls last, model_id desc) as rn from eloquent_models where node_id is not null) where rn = 1 group by 1, 2) m on m.repo = c.repo and m.t = c.tab"""
    ),
    "graph_status": with_parts(
        r""", folder as (select distinct repo, array_to_string(p[1:i], '/') as f from (select repo, string_split(path, '/') as p from source_files), lateral (select unnest(range(1, len(p))) as i) where len(p) > 1),
      blade as (select file_id, repo, replace(regexp_replace(regexp_replace(path, '^.*?views/', ''), '\.blade\.php$', ''), '/', '.') as view, regexp_replace(content, '(?s)\{\{--.*?--\}\}', '', 'g') as t from source_files where extension = '.blade.php'),
      link as (select distinct file_id, repo, rel, x from (select file_id, repo, 'EXTENDS_TEMPLATE' as rel, unnest(regexp_extract_all(t, '@extends\(\s*''([^'']+)''', 1)) as x from blade where t is not null union all select file_id, repo, 'INCLUDES_TEMPLATE', unnest(regexp_extract_all(t, '@(?:include(?:If)?|each)\(\s*''([^'']+)''', 1)) from blade where t is not null)),
      setting as (select repo, path, x[1] as kind, x[2] as key from (select repo, path, unnest(list_zip(regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 1), regexp_extract_all(content, '\b(config|env)\(\s*''([\w.-]+)''', 2))) as x from php where content is not null)),
      conf as (select distinct repo, regexp_extract(path, '(\w+)\.php$', 1) || '.' || n as key from (select repo, path, unnest(regexp_extract_all(content, '(?m)^    ''(\w+)''\s*=>', 1)) as n from source_files where regexp_matches(path, '^config/\w+\.php$') and content is not null)),
      node as (select 'Folder' as name, count(*) as n from folder union all select 'File', count(*) from source_files union all select 'Method', count(*) from meth union all select 'Route', count(distinct node) from route union all select 'BladeTemplate', count(*) from blade
        union all select 'DatabaseTable', count(*) from live union all select 'DatabaseColumn', count(distinct (repo, tab, "column")) from col union all select 'EloquentModel', count(distinct node_id) from eloquent_models union all select 'ConfigKey', count(*) from conf
        union all select 'EnvVariable', count(distinct (repo, key)) from setting where kind = 'env' union all select label, count(*) from sym group by 1),
      edge as (select 'CONTAINS' as name, (select count(*) from folder where contains(f, '/')) + (select count(*) from source_files where contains(path, '/')) as n union all select 'DEFINES', (select count(*) from deff) + (select count(*) from defm) + (select count(distinct (file_id, node)) from route) + (select count(*) from blade)
        union all select 'IMPORTS', count(*) from parsed_uses u join sym s on s.key = """
        + _KEY.format("u.fqn")
        + r""" join source_files f on f.file_id = u.file_id join source_files g on g.file_id = s.file_id where u.file_id <> s.file_id union all select 'CALLS', count(*) from called union all select 'USES_TYPE', count(*) from tuse union all select 'ROUTES_TO', count(*) from handler union all select 'USES_TABLE', count(*) from modeltab
        union all select 'QUERIES_TABLE', count(*) from qtab union all select 'HAS_COLUMN', count(*) from (select distinct repo, tab, "column" from col) c join live l on l.repo = c.repo and l.table_key = c.tab union all select rel, count(*) from link l join blade b on b.repo = l.repo and b.view = l.x group by 1
        union all select case kind when 'env' then 'USES_ENV' else 'USES_CONFIG' end, count(*) from setting group by 1 union all select rel, count(*) from heir group by 1)
      select 'label' as kind, name, n from node where n > 0 union all select 'relation', name, n from edge where n > 0"""
    ),
}

_ENTRY = "(select dst as node from handler union select node from meth where name = 'handle')"
_STEM = "regexp_replace(regexp_replace({0}, 'ies$', 'y'), '([a-z][a-z][a-z])(?:es|s)$', '\\1')"
_TOKENS = r"list_distinct([t for t in string_split(lower(trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') if length(t) >= 3])"
_FEATURES = f""", r as (select distinct node, {_WORD} as feature from (select distinct node, uri from route)), f as (select feature, {_STEM.format('feature')} as w from (select feature, count(*) as n from r group by 1) where feature <> 'general' or n <= 20),
  words as (select node, {_STEM.format('t')} as w from (select node, unnest({_TOKENS}) as t from sym where label = 'Class_')),
  cand as (select node, feature, 0 as k, length(words.w) as n from words join f on f.w = words.w union all select node, feature, 1, 4 from words join f on left(f.w, 4) = left(words.w, 4) where length(f.w) >= 4 and length(words.w) >= 4),
  best as (select node, arg_min((feature, k), (k, -n, feature)) as x from cand group by 1),
  link as (select feature, node, 'route' as match_type from r where feature in (select feature from f) union all select x[1], node, case when x[2] = 0 then 'exact' else 'prefix' end from best)"""

SQL |= {
    "tool_flows": with_parts(
        f""", e as (select distinct src, dst from called where method), w as (select node as root, node, 0 as depth from {_ENTRY} union select w.root, e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 5),
      m as (select root, node, min(depth) as depth from w group by 1, 2) select root, node, depth, step_order from (select *, cast(row_number() over (partition by root order by depth, node) - 1 as integer) as step_order from m) where step_order < 200""",
        recursive=True,
    ),
    "tool_cross_cutting": with_parts(
        r"""select dst as node_id, count(distinct file_path) as n_units, count(distinct layer) as n_layers, case when count(distinct file_path) >= 8 or count(distinct layer) >= 4 then 'HIGH' else 'MEDIUM' end as severity
      from (select c.dst, m.file_path, case when m.file_path is not null then regexp_extract(m.file_path, '^(?:app/)?([^/]+)', 1) end as layer from called c join meth m on m.node = c.src where c.method) group by 1 having count(distinct file_path) >= 3 and count(distinct layer) >= 2"""
    ),
    "tool_features": with_parts(_FEATURES + r""" select feature, array_to_string([upper(left(p, 1)) || substr(p, 2) for p in string_split(replace(replace(feature, '-', ' '), '_', ' '), ' ')], ' ') as title, node as node_id, match_type from link"""),
    "tool_feature_context": with_parts(_FEATURES + " select feature, count(*) filter (where match_type = 'route') as n_routes, count(*) filter (where match_type = 'exact') as n_exact, count(*) filter (where match_type = 'prefix') as n_near from link group by 1"),
    "db_access": with_parts("select via, op as operation, target, count(*) as n from acc group by 1, 2, 3"),
}

_MEANT = "(select n.file_id, n.name, coalesce(s0.node, s1.node) as node from (select distinct file_id, name from {0}) n join fileid i using (file_id) left join alias a on a.file_id = n.file_id and a.alias = n.name left join sym s0 on s0.key = a.key left join short h on h.repo = i.repo and h.name = n.name left join sym s1 on s1.key = h.key)"
SQL["graph_framework"] = with_parts(
    _FEATURES
    + _SCANNED
    + rf""", owner as (select file_id, min(node) as node from sym where file_id is not null group by 1),
  asked as (select file_id, case when x[1] = '__construct' then 'constructor' else 'method' end as how, list_extract(string_split(regexp_extract(trim(unnest(string_split(x[2], ','))), '(?:^|[(\s])\??\\?([A-Z][\w\\]*)\s+\$\w+', 1), '\'), -1) as name
    from (select file_id, unnest(list_zip(regexp_extract_all(content, 'function\s+(\w+)\(([^)]*)\)', 1), regexp_extract_all(content, 'function\s+(\w+)\(([^)]*)\)', 2))) as x from php where content is not null)),
  heard as (select min(file_id) as file_id, event, listener from (select file_id, unnest(regexp_extract_all(content, 'function\s+handle\(\s*\\?([A-Z][\w\\]*)\s+\$', 1)) as event, regexp_extract(path, '(\w+)\.php$', 1) as listener from php where contains(path, '/Listeners/') and content is not null) group by 2, 3),
  ear as (select file_id, event as full_, list_extract(string_split(event, '\'), -1) as name from heard), mouth as (select file_id, listener as name from heard)
  select rel, detail, count(*) as n from (
    select distinct 'INJECTS' as rel, o.node as src, m.node as dst, a.how as detail from asked a join owner o using (file_id) join {_MEANT.format('asked')} m on m.file_id = a.file_id and m.name = a.name where m.node is not null
    union all select distinct case s.role when 'request' then 'VALIDATES_WITH' else 'TRANSFORMS_WITH' end, t.src, t.dst, t.role from tuse t join sym s on s.node = t.dst where s.role in ('request', 'resource')
    union all select 'HAS_PERFORMANCE_RISK', method, null, risk from ({_RISKS}) union all select 'BELONGS_TO_FEATURE', node, feature, match_type from link
    union all select 'LISTENS_TO', l.node, e.node, 'type' from heard h join {_MEANT.format('ear')} e on e.file_id = h.file_id and e.name = list_extract(string_split(h.event, '\'), -1) join {_MEANT.format('mouth')} l on l.file_id = h.file_id and l.name = h.listener where e.node is not null and l.node is not null)
  group by 1, 2"""
)
