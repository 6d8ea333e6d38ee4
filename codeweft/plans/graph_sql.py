"""The code graph in SQL, as common table expressions that the SQL of the tools is made of.

Written from the tables and literal values alone, without the engine's constants or patterns where
another wording says the same, so that equal rows mean something.
"""

from __future__ import annotations

import re

from codeweft.plans.code_queries import _KEY, _TABLE

_PLAIN = (
    "array_map array_filter array_reduce array_merge array_push array_pop array_shift array_unshift array_keys array_values array_key_exists array_search array_slice array_splice array_unique array_flip array_combine "
    "array_chunk array_diff array_intersect array_pad array_column array_fill count sizeof strlen str_len strtolower strtoupper substr strpos strrpos str_replace str_contains str_starts_with str_ends_with trim ltrim "
    "rtrim explode implode join sprintf printf intval floatval strval boolval is_null is_array is_string is_int is_float is_bool is_object isset empty unset in_array json_encode json_decode preg_match preg_replace "
    "preg_split preg_match_all date time strtotime mktime microtime class_exists method_exists property_exists function_exists get_class get_parent_class instanceof call_user_func call_user_func_array throw new echo "
    "print die exit app config env route url redirect response request session view trans __ trans_choice abort abort_if abort_unless back collect data_get data_set optional rescue tap value with filled blank "
    "class_basename str now today yesterday tomorrow dispatch broadcast event info logger report report_if throw_if throw_unless validator"
)
_ROLE = """case when starts_with({p}, 'app/Models/') then 'model' when starts_with({p}, 'app/Http/Controllers/') then 'controller' when starts_with({p}, 'app/Http/Middleware/') then 'middleware' when starts_with({p}, 'app/Jobs/') then 'job'
  when starts_with({p}, 'app/Events/') then 'event' when starts_with({p}, 'app/Listeners/') then 'listener' when starts_with({p}, 'app/Policies/') then 'policy' when starts_with({p}, 'app/Http/Requests/') then 'request'
  when starts_with({p}, 'app/Http/Resources/') then 'resource' when starts_with({p}, 'app/Notifications/') then 'notification' when starts_with({p}, 'app/Observers/') then 'observer' when starts_with({p}, 'app/Console/Commands/') then 'command'
  when starts_with({p}, 'app/Providers/') then 'provider' when starts_with({p}, 'database/factories/') then 'factory' when starts_with({p}, 'database/seeders/') then 'seeder' when starts_with({p}, 'database/migrations/') then 'migration'
  when starts_with({p}, 'routes/') then 'route_file' else 'php' end"""
_BY_PARENT = """case list_extract(string_split(extends, '\\'), -1) when 'Model' then 'model' when 'Authenticatable' then 'model' when 'Pivot' then 'model' when 'Controller' then 'controller' when 'BaseController' then 'controller' when 'FormRequest' then 'request'
  when 'Resource' then 'resource' when 'JsonResource' then 'resource' when 'ResourceCollection' then 'resource' when 'Notification' then 'notification' when 'Mailable' then 'mailable' when 'Job' then 'job' when 'Queueable' then 'job'
  when 'Event' then 'event' when 'Listener' then 'listener' when 'Policy' then 'policy' when 'Observer' then 'observer' when 'Command' then 'command' when 'ServiceProvider' then 'provider' when 'Factory' then 'factory' when 'Seeder' then 'seeder'
  when 'DatabaseSeeder' then 'seeder' when 'Middleware' then 'middleware' else 'php' end"""
_SNAKE = r"lower(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'))"
_PLURAL = "case when ends_with({0}, 'y') and not ends_with({0}, 'ey') then left({0}, -1) || 'ies' when ends_with({0}, 's') or ends_with({0}, 'x') or ends_with({0}, 'z') or ends_with({0}, 'ch') or ends_with({0}, 'sh') then {0} || 'es' else {0} || 's' end"
_ROUTE = r"Route::(get|post|put|patch|delete|options|any)\(\s*''([^'']*)''\s*,\s*\[\s*([\w\\]+)::class\s*,\s*''(\w+)''\s*\]"
_COLUMN = r"\$table->(\w+)\((?:''(\w+)'')?[^;]*;"
_CALL = r"(?:(\$\w+->|\\?[A-Za-z_][\w\\]*::)|(?:^|[^\w>:$\\]))([A-Za-z_]\w*)\("
_ID = r"replace({0}, '\\', '\')"

#: name -> (names it rests on, text)
PARTS: dict[str, str] = {
    "php": "select file_id, repo, path, content from source_files where extension = '.php'",
    "fileid": "select file_id, repo, path, 'file:' || coalesce(repo, '') || '::' || coalesce(path, '') as node from source_files",
    "held": f"select {_KEY.format('fqn')} as key, *, row_number() over (partition by {_KEY.format('fqn')} order by parsed_at desc nulls last, class_id desc) as rn from parsed_classes where {_KEY.format('fqn')} is not null",
    "sym": f"""select key, fqn, kind, name, repo, file_id, file_path, line_start, extends, implements, traits, case kind when 'trait' then 'Trait_' when 'interface' then 'Interface_' when 'enum' then 'Enum_' else 'Class_' end as label,
      {_ID.format("case kind when 'trait' then 'trait_' when 'interface' then 'interface_' when 'enum' then 'enum_' else 'class_' end || ':' || key")} as node,
      case when {_ROLE.format(p='file_path')} = 'php' then case when extends is null then 'php' else {_BY_PARENT} end else {_ROLE.format(p='file_path')} end as role from held where rn = 1 and removed_at is null""",
    "meth": f"""select node_id as node, repo, file_id, file_path, name, fqn, line_start, line_end, param_types, return_type, method_id, {_KEY.format("string_split(fqn, '::')[1]")} as class_key
      from (select *, row_number() over (partition by node_id order by parsed_at desc nulls last, method_id desc) as rn from methods where node_id is not null) where rn = 1""",
    "heir": f"""select n.node as src, rel, t.node as dst from (select node, 'EXTENDS_CLASS' as rel, extends as p from sym union all select node, 'IMPLEMENTS_INTERFACE', unnest(implements) from sym union all select node, 'USES_TRAIT', unnest(traits) from sym) n
      join sym t on t.key = {_KEY.format('n.p')}""",
    "route": rf"""select file_id, repo, path, upper(x[1]) as verb, x[2] as uri, coalesce(u.fqn, x[3]) as controller, x[4] as action, 'route:' || coalesce(repo, '') || '::' || upper(x[1]) || ':' || x[2] as node
      from (select file_id, repo, path, unnest(list_zip(regexp_extract_all(content, '{_ROUTE}', 1), regexp_extract_all(content, '{_ROUTE}', 2), regexp_extract_all(content, '{_ROUTE}', 3), regexp_extract_all(content, '{_ROUTE}', 4))) as x from php where starts_with(path, 'routes/'))
      left join (select file_id as f, alias, min(fqn) as fqn from used group by 1, 2) u on u.f = file_id and u.alias = x[3]""",
    "used": r"""select file_id, coalesce(nullif(x[2], ''), list_extract(string_split(x[1], '\'), -1)) as alias, ltrim(x[1], '\') as fqn from (select file_id, unnest(list_zip(regexp_extract_all(content, '(?m)^use\s+([A-Za-z_\\][\w\\]*)(?:\s+as\s+(\w+))?\s*;', 1),
      regexp_extract_all(content, '(?m)^use\s+([A-Za-z_\\][\w\\]*)(?:\s+as\s+(\w+))?\s*;', 2))) as x from php where content is not null)""",
    "alias": f"select file_id, alias, min({_KEY.format('fqn')}) as key from used group by 1, 2",
    "short": r"select repo, name, arg_min(key, (case when starts_with(fqn, 'App\Models\') or starts_with(fqn, 'App\Services\') or starts_with(fqn, 'App\Http\Controllers\') then 0 else 1 end, key)) as key from sym group by 1, 2",
    "lines": r"select file_id, repo, generate_subscripts(l, 1) as line, unnest(l) as text from (select file_id, repo, string_split_regex(content, '\r\n|\n|\r') as l from php where content is not null)",
    "span": "select file_id, line_start, coalesce(line_end, 2147483647) as line_end, node, class_key from meth where file_id is not null and line_start is not null",
    "site": rf"""select file_id, repo, line, case when r in ('this', 'self', 'static') and raw <> '' then 'self' when ends_with(raw, '::') then 'static' when ends_with(raw, '->') then 'instance' else 'free' end as kind, case when raw <> '' then r end as receiver, name
      from (select file_id, repo, line, x[1] as raw, regexp_replace(regexp_replace(x[1], '^[$\\]', ''), '(?:->|::)$', '') as r, x[2] as name from (select file_id, repo, line, unnest(list_zip(regexp_extract_all(t, '{_CALL}', 1), regexp_extract_all(t, '{_CALL}', 2))) as x
        from (select file_id, repo, line, replace(regexp_replace(text, '\bnew [A-Za-z_]\w*\(', 'new (', 'g'), '(', '( ') as t from lines where contains(text, '(') and not regexp_matches(text, '^\s*(?:\*|//|#|/\*)|\bfunction\s+&?\w+\('))))
      where not starts_with(name, '__') and not list_contains(string_split('{_PLAIN}', ' '), name)
        and not (raw = '' and lower(name) in ('if', 'elseif', 'while', 'for', 'foreach', 'switch', 'match', 'array', 'list', 'function', 'fn', 'return', 'catch', 'use', 'and', 'or', 'xor', 'declare', 'include', 'require', 'include_once', 'require_once'))""",
    "called": rf"""select src, coalesce(m.node, c.node) as dst, m.node is not null as method, call_type, line, case call_type when 'self' then case when m.node is null then 0.6 else 0.9 end when 'static' then case when m.node is null then 0.7 else 0.85 end
        when 'facade' then case when m.node is null then 0.75 else 0.85 end else case when m.node is null then 0.4 else 0.5 end end as confidence
      from (select s.src, s.line, s.name, case when s.kind = 'self' or (s.kind = 'free' and s.caller is not null) then 'self' when s.kind = 'static' and s.receiver in ('Cache','Config','DB','Event','Gate','Hash','Http','Log','Mail','Notification','Queue','Redis','Route','Schema','Session',
          'Storage','URL','Validator','View','Auth','Bus','Broadcast','Crypt','File','Artisan','Response','Request','Cookie','Redirect') then 'facade' else s.kind end as call_type,
          case when s.kind = 'self' or (s.kind = 'free' and s.caller is not null) then s.caller else coalesce(a.key, f.key, h.key) end as key
        from placed s left join alias a on a.file_id = s.file_id and a.alias = s.receiver left join sym f on f.key = {_KEY.format('s.receiver')} left join short h on h.repo = s.repo and h.name = s.receiver) x
      left join (select class_key, name, min(node) as node from meth group by 1, 2) m on m.class_key = x.key and m.name = x.name left join sym c on c.key = x.key
      where call_type <> 'facade' and (m.node is not null or c.node is not null)""",
    "placed": """select s.file_id, s.repo, s.line, s.kind, s.receiver, s.name, p.node as src, p.class_key as caller from (select *, row_number() over () as id from site) s
      join lateral (select node, class_key, line_end from span where span.file_id = s.file_id and span.line_start <= s.line order by line_start desc, line_end desc, node desc limit 1) p on true where p.line_end >= s.line""",
    "live": f"""select repo, k as table_key, node_id as node, name, connection, source from (select *, {_TABLE.format('name')} as k, row_number() over (partition by repo, {_TABLE.format('name')} order by created_at desc nulls last, table_id desc) as rn from db_tables
      where {_TABLE.format('name')} is not null and repo is not null) where rn = 1 and dropped_at is null""",
    "mcol": rf"""select file_id, tab, kind, name from (select file_id, m[1] as tab, unnest(list_zip(regexp_extract_all(m[2], '{_COLUMN}', 1), regexp_extract_all(m[2], '{_COLUMN}', 2))) as x, x[1] as kind, coalesce(x[2], '') as name from (select file_id, unnest(list_zip(
        regexp_extract_all(content, '(?s)Schema::(?:create|table)\(\s*''(\w+)''\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{{]*\{{(.*?)\n\s*\}}\);', 1), regexp_extract_all(content, '(?s)Schema::(?:create|table)\(\s*''(\w+)''\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{{]*\{{(.*?)\n\s*\}}\);', 2))) as m
        from source_files where contains(path, 'database/migrations/') and content is not null))""",
    "col": """select distinct file_id, repo, tab, c[1] as "column", c[2] as type from (select file_id, tab, unnest(case when kind = 'id' and name = '' then [['id', 'bigint']] when kind in ('timestamps', 'nullableTimestamps') then [['created_at', 'timestamp'], ['updated_at', 'timestamp']]
      when kind = 'softDeletes' then [['deleted_at', 'timestamp']] when kind = 'rememberToken' then [['remember_token', 'string']] when name <> '' and kind not in ('index', 'unique', 'primary', 'foreign', 'dropColumn', 'dropIndex', 'renameColumn', 'dropForeign')
      then [[name, case when kind in ('foreignId', 'unsignedBigInteger', 'bigInteger', 'bigIncrements') then 'bigint' when kind in ('increments', 'unsignedInteger') then 'integer' else lower(kind) end]] else [] end) as c from mcol) join source_files using (file_id)""",
    "modeltab": f"""select distinct m.node_id as node, m.name, m.repo, l.node as tab from (select *, coalesce({_TABLE.format('db_table')}, {_PLURAL.format(_SNAKE.format('name'))}) as k from eloquent_models) m join live l on l.repo = m.repo and l.table_key = m.k""",
    "acc": r"""select file_id, repo, line, target, op, via from (
      select *, 'query_builder' as via, unnest(regexp_extract_all(text, 'DB::table\(\s*''(\w+)''', 1)) as target, oo as op from ops union all select *, 'join', unnest(regexp_extract_all(text, '->(?:left|right|cross)?[jJ]oin\(\s*''(\w+)''', 1)), 'read' from ops
      union all select *, 'raw_sql', unnest(regexp_extract_all(text, '(?i)DB::(?:select|statement|insert|update|delete|raw)\(\s*["''][^"'']*?\b(?:from|into|update|join)\s+`?(\w+)', 1)), case when regexp_matches(lower(text), 'insert|update|delete') then 'write' else 'read' end from ops
      union all select *, 'static_orm', unnest(regexp_extract_all(text, '\b([A-Z]\w*)::(?:query|where\w*|find\w*|all|create|first\w*|update\w*|with|insert|destroy|count)\(', 1)), oo from ops
      union all select *, 'instance_write', unnest(regexp_extract_all(text, '\$(\w+)->(?:save|delete|update|forceDelete)\(', 1)), case when regexp_matches(text, '->(?:delete|forceDelete)\(') then 'delete' else 'write' end from ops) where target not in ('DB', 'Route', 'Schema', 'Cache', 'Log', 'this')""",
    "ops": r"""select *, case when regexp_matches(text, '(?:->|::)(?:insert|create|upsert|insertGetId|firstOrCreate|updateOrCreate|save|update|increment|decrement)\(') then 'write' when regexp_matches(text, '(?:->|::)(?:delete|truncate|destroy)\(') then 'delete' else 'read' end as oo
      from lines where not regexp_matches(text, '^\s*(?:\*|//|#|/\*)')""",
    "qtab": """select p.node as src, coalesce(m.tab, l.node) as dst, s.line, s.op from (select *, row_number() over () as id from acc) s
      join lateral (select node, line_end from span where span.file_id = s.file_id and span.line_start <= s.line order by line_start desc, line_end desc, node desc limit 1) p on p.line_end >= s.line
      left join (select repo, name, min(tab) as tab from modeltab group by 1, 2) m on m.repo = s.repo and m.name = s.target left join live l on l.repo = s.repo and l.table_key = s.target where coalesce(m.tab, l.node) is not null""",
    "typed": r"""select distinct src, file_id, repo, list_extract(string_split(t, '\'), -1) as name, role from (select node as src, file_id, 'return' as role, unnest(string_split_regex(regexp_replace(coalesce(return_type, ''), '[?()\s]', '', 'g'), '[|&]')) as t from meth
        union all select src, file_id, 'param', unnest(string_split_regex(regexp_replace(q, '[?()\s]', '', 'g'), '[|&]')) from (select node as src, file_id, unnest(cast(json(param_types) as varchar[])) as q from meth where json_valid(param_types))) join source_files using (file_id)
      where ltrim(t, '\') <> '' and ltrim(t, '\') not in ('int','integer','float','double','string','bool','boolean','null','void','never','array','callable','iterable','mixed','object','resource','self','static','parent','$this','true','false')""",
    "tuse": "select t.src, coalesce(s0.node, s1.node) as dst, t.role from typed t left join alias a on a.file_id = t.file_id and a.alias = t.name left join sym s0 on s0.key = a.key left join short h on h.repo = t.repo and h.name = t.name left join sym s1 on s1.key = h.key where coalesce(s0.node, s1.node) is not null",
    "handler": f"""select distinct r.node as src, m.node as dst from route r left join sym f on f.key = {_KEY.format('r.controller')} left join short h on h.repo = r.repo and h.name = list_extract(string_split(r.controller, '\\'), -1)
      join (select class_key, name, min(node) as node from meth group by 1, 2) m on m.class_key = coalesce(f.key, h.key) and m.name = r.action""",
    "defm": "select s.node as src, m.node as dst from meth m join sym s on s.key = m.class_key",
    "deff": "select f.node as src, s.node as dst from sym s join fileid f using (file_id)",
}


def _needs(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    for other in PARTS:
        if other != name and re.search(rf"\b(?:from|join)\s+{other}\b", PARTS[name]):
            _needs(other, seen)
    if name not in seen:
        seen.append(name)


def with_parts(sql: str, recursive: bool = False) -> str:
    """``sql`` with the parts that it names before it."""
    seen: list[str] = []
    for name in PARTS:
        if re.search(rf"\b(?:from|join)\s+{name}\b", sql):
            _needs(name, seen)
    return f"with {'recursive ' if recursive else ''}" + ",\n  ".join(f"{n} as ({PARTS[n]})" for n in seen) + (" " if not sql.startswith(",") else "") + sql
