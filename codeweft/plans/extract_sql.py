"""The SQL of the extraction, search and quality queries that need more than a line."""

from __future__ import annotations

_STATEMENTS = r"""(select file_id, m[1] as tab, s from (select file_id, unnest(list_zip(regexp_extract_all(content, '(?s)Schema::(?:create|table)\(\s*''(\w+)''\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{]*\{(.*?)\n\s*\}\);', 1),
    regexp_extract_all(content, '(?s)Schema::(?:create|table)\(\s*''(\w+)''\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{]*\{(.*?)\n\s*\}\);', 2))) as m from source_files where contains(path, 'database/migrations/') and content is not null), lateral (select unnest(string_split(m[2], ';')) as s) where contains(s, '$table->'))"""
_COLUMNS = rf"""select file_id, tab as "table", c[1] as "column", c[2] as type, c[3] = 'y' as nullable, contains(s, '->unique(') as is_unique, ref as references_table from (
  select file_id, tab, s, case when r <> '' then r when kind = 'foreignId' then (case when ends_with(b, 'y') and not ends_with(b, 'ey') then left(b, -1) || 'ies' when regexp_matches(b, '(s|x|z|ch|sh)$') then b || 'es' else b || 's' end) end as ref,
    unnest(case when kind = 'id' and name = '' then [['id', 'bigint', 'n']] when kind in ('timestamps', 'nullableTimestamps') then [['created_at', 'timestamp', 'y'], ['updated_at', 'timestamp', 'y']] when kind = 'softDeletes' then [['deleted_at', 'timestamp', 'y']]
      when kind = 'rememberToken' then [['remember_token', 'string', 'y']] when name <> '' and kind not in ('index', 'unique', 'primary', 'foreign', 'dropColumn', 'dropIndex', 'renameColumn', 'dropForeign')
      then [[name, case when kind in ('foreignId', 'unsignedBigInteger', 'bigInteger', 'bigIncrements') then 'bigint' when kind in ('increments', 'unsignedInteger') then 'integer' else lower(kind) end, case when contains(s, '->nullable(') then 'y' else 'n' end]] else [] end) as c
  from (select *, regexp_extract(s, '\$table->(\w+)\(', 1) as kind, regexp_extract(s, '\$table->\w+\(\s*''(\w+)''', 1) as name, regexp_replace(regexp_extract(s, '\$table->\w+\(\s*''(\w+)''', 1), '_id$', '') as b, regexp_extract(s, '->(?:on|constrained)\(\s*''(\w+)''', 1) as r from {_STATEMENTS}))"""
_LIST = r"regexp_extract_all(regexp_extract(content, '(?s)\${0}\s*=\s*\[(.*?)\]', 1), '''([^'']*)''', 1)"
_CLASS_TABLE = r"lower(regexp_replace(regexp_replace(n, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'))"
_MODELS = rf"""select file_id, case when t <> '' then t when ends_with(s, 'y') then left(s, -1) || 'ies' when regexp_matches(s, '(s|x|z|ch|sh)$') then s || 'es' else s || 's' end as db_table, contains(content, 'SoftDeletes') as soft_deletes, not regexp_matches(content, '\$timestamps\s*=\s*false') as timestamps,
    {_LIST.format('fillable')} as fillable, {_LIST.format('guarded')} as guarded, {_LIST.format('with')} as eager
  from (select *, {_CLASS_TABLE} as s from (select *, regexp_extract(content, 'protected\s+(?:string\s+)?\$table\s*=\s*''([^'']*)''', 1) as t, regexp_extract(path, '(\w+)\.php$', 1) as n from source_files where extension = '.php' and contains(path, 'Models/') and content is not null))"""
_RULES = r"(select file_id, unnest(regexp_extract_all(body, '''([\w.*]+)''\s*=>\s*(?:''[^'']*''|\[[^\]]*\])', 1)) as field from (select file_id, unnest(regexp_extract_all(content, '(?s)function\s+rules\(\)[^{]*\{(.*?)\n    \}', 1)) as body from source_files where extension = '.php' and content is not null))"

SQL = {
    "migration_columns": _COLUMNS,
    "discriminators": f"""select distinct "table", "column", regexp_matches(lower("column"), '_(type|status|state|kind|mode|flag)$') or starts_with(lower("column"), 'is_') or starts_with(lower("column"), 'has_') or contains(type, 'tinyint') or contains(type, 'smallint') or contains(type, 'enum') as is_discriminator
      from (select distinct "table", "column", type from ({_COLUMNS}))""",
    "injections": r"""with s as (select unnest(list_zip(regexp_extract_all(content, 'function\s+(\w+)\(([^)]*)\)', 1), regexp_extract_all(content, 'function\s+(\w+)\(([^)]*)\)', 2))) as x from source_files where extension = '.php' and content is not null),
      p as (select x[1] as method, trim(unnest(string_split(x[2], ','))) as p from s), t as (select method, regexp_extract(p, '(?:^|[(\s])\??\\?([A-Z][\w\\]*)\s+\$\w+', 1) as type from p)
      select case when method = '__construct' then 'constructor' else 'method' end as injection, type, count(*) as n from t where type <> '' group by 1, 2""",
    "model_facts": _MODELS,
    "contracts": rf"""select kind, subject, count(*) as n from (select 'validation' as kind, field as subject from {_RULES}
      union all select 'authorization', x from (select unnest(regexp_extract_all(content, 'public\s+(?:static\s+)?function\s+(\w+)\(', 1)) as x from source_files where extension = '.php' and contains(path, '/Policies/') and content is not null) where not starts_with(x, '__')
      union all select 'lifecycle', unnest(regexp_extract_all(content, 'static::(creating|created|updating|updated|saving|saved|deleting|deleted|restoring|restored)\(', 1)) from source_files where extension = '.php' and content is not null
      union all select 'mass_assignment', unnest(fillable) from ({_MODELS})) group by 1, 2""",
    "switch_maps": r"""with b as (select unnest(regexp_extract_all(content, '(?s)match\s*\([^)]*\)\s*\{(.*?)\};', 1)) as body from source_files where extension = '.php' and content is not null),
      a as (select trim(unnest(string_split(body, chr(10)))) as arm from b where len(regexp_extract_all(body, '=>')) >= 2),
      k as (select trim(regexp_replace(trim(unnest(string_split(regexp_extract(arm, '^(.*?)\s*=>', 1), ','))), '^''|''$', '', 'g')) as key, regexp_extract(arm, '=>\s*([^,]+)', 1) as value from a where contains(arm, '=>'))
      select key, trim(value) as value, count(*) as n from k where key <> '' group by 1, 2""",
    "manifests": r"""select file_id, json_extract_string(j, '$.name') as name, json_extract_string(j, '$.require.php') as php_constraint, cast(len(list_distinct(coalesce(json_keys(j, '$.require'), []) || coalesce(json_keys(j, '$."require-dev"'), []))) as integer) as n_packages
      from (select file_id, case when json_valid(content) then content end as j from source_files where path = 'composer.json' or ends_with(path, '/composer.json'))""",
    "quality_report": r"""with v as (select 'lang' as c, lang as v from documents union all select 'source', source from documents union all select 'text', text from documents),
      k as (select c, v, regexp_replace(lower(trim(v, ' ')), '[\s_-]+', '', 'g') as normal, count(*) as n from v where v is not null group by 1, 2, 3), size as (select c, count(*) as k, sum(n) as r from k group by 1),
      dup as (select c, normal, list_sort(list(v)) as s, cast(sum(n) as bigint) as n from k group by 1, 2 having count(*) > 1),
      mixed as (select c, count(*) filter (where v is null) as a, count(*) filter (where trim(v, ' ') = '') as b, count(*) as r from v group by 1)
      select 'documents' as "table", c as "column", finding, detail, n from (select d.c, 'ENUM_NEAR_DUPLICATE' as finding, array_to_string(s, '|') as detail, n from dup d join size z on z.c = d.c where k <= 30 and r >= 10
        union all select c, 'STATUS_MIXED_EMPTY', '', a + b from mixed where a > 0 and b > 0 and r >= 10) order by n desc, c, finding, detail limit 50""",
}
