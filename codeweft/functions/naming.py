"""Rules about names: tables from classes, slugs from paths, tokens, roles, types, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft.functions.fixed import DB_TYPES, NOISE, PARENT_ROLES, RELATION_CALLS, ROLE_PREFIXES, SCALARS

def snake(c: Column) -> Column:
    """CamelCase to snake_case, a run of capitals being one word."""
    x = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2"))


def snake_plain(c: Column) -> Column:
    """CamelCase to snake_case, a capital with small letters after it beginning a word wherever it stands."""
    x = F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2"))


def plural(c: Column) -> Column:
    """Naive plural: y to ies unless e stands before it, es after s, x, z, ch and sh, else s."""
    return F.when(c.rlike(r"[^e]y$|^y$"), F.regexp_replace(c, "y$", "ies")).when(c.rlike(r"(?:s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def plural_plain(c: Column) -> Column:
    """Naive plural: a final y always becomes ies, es after s, x, z, ch and sh, else s."""
    return F.when(c.endswith("y"), F.regexp_replace(c, "y$", "ies")).when(c.rlike(r"(?:s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def table_of_class(name: Column) -> Column:
    """The table that the link of models to tables expects for a class."""
    return plural(snake(name))


def table_of_model(name: Column) -> Column:
    """The table that a model has when it names none."""
    return plural_plain(snake_plain(name))


def short_name(fqn: Column) -> Column:
    """The last part of a qualified name."""
    return F.element_at(F.split(fqn, r"\\"), -1)


def name_tokens(c: Column) -> Column:
    """Lower-case parts of a camel, snake or spaced name, at least three letters long, each once in order."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda x: F.length(x) >= 3))


def feature_slug(uri: Column) -> Column:
    """The first telling part of a path with underscores for hyphens, parameters and noise left out; general when none is left."""
    parts = F.filter(F.split(F.lower(F.coalesce(uri, F.lit(""))), "/"), lambda x: (x != "") & ~x.rlike(r"^\{[^}]+\}$") & ~x.isin(*NOISE))
    return F.coalesce(F.replace(F.get(parts, F.lit(0)), F.lit("-"), F.lit("_")), F.lit("general"))


def slug_title(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def method_tag(name: Column) -> Column:
    """What a method of a model or handler is by its name."""
    return (
        F.when(name.isin(*RELATION_CALLS[:11]), "relationship").when(name.rlike(r"^scope[A-Z]"), "scope").when(name.startswith("get") & name.endswith("Attribute"), "accessor")
        .when(name.startswith("set") & name.endswith("Attribute"), "mutator").when(name.isin("boot", "booted"), "boot").when(name == "register", "register").when(name == "handle", "handle")
    )


#: Bytes up to which a file outside the usual folders is looked into for its role.
ROLE_BYTES = 64 * 1024


def file_role(path: Column, content: Column | None = None) -> Column:
    """The role of a source file by where it lies; a small php file elsewhere that extends a model is one."""
    out = F.when(path.endswith(".blade.php") & path.startswith("resources/views/"), "blade")
    for prefix, role in ROLE_PREFIXES:
        out = out.when(path.startswith(prefix), role)
    if content is not None:
        out = out.when(path.endswith(".php") & (F.octet_length(content) < ROLE_BYTES) & (content.contains("extends Model") | content.contains("extends Authenticatable")), "model")
    return out.otherwise("php")


def class_role(file_role_: Column, parent: Column) -> Column:
    """The role of a class: that of its file, or where the place of the file tells none, that of its parent's short name."""
    known = F.create_map(*[F.lit(x) for kv in PARENT_ROLES.items() for x in kv])
    return F.when(F.coalesce(file_role_, F.lit("")).isin("php", ""), F.coalesce(known[short_name(parent)], F.lit("php"))).otherwise(file_role_)


def class_types(declared: Column) -> Column:
    """The class names of a declared type: nullable mark off, union and intersection split, scalars dropped (as spelled)."""
    parts = F.split(F.regexp_replace(F.coalesce(declared, F.lit("")), r"[?()\s]", ""), r"[|&]")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\\", "")), lambda x: (x != "") & ~x.isin(*SCALARS))


def db_type(declared: Column) -> Column:
    """The common name of a database type, whatever its length and case; unknown ones in lower case."""
    bare = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1))
    known = F.create_map(*[F.lit(x) for kv in DB_TYPES.items() for x in kv])
    return F.coalesce(known[bare], F.lower(declared))


def stable_id(*parts: Column) -> Column:
    """Ten hexadecimal digits of the hash of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def sql_key(sql: Column) -> Column:
    """A cache key: sixteen digits of the hash of a statement without regard to white space and case."""
    return F.substring(F.sha1(F.upper(F.trim(F.regexp_replace(sql, r"\s+", " ")))), 1, 16)


def is_env_key(key: Column) -> Column:
    """Whether a setting is one of the environment: capitals with an underscore."""
    return key.rlike(r"^[A-Z0-9_]+$") & key.contains("_")


def clean_docblock(doc: Column) -> Column:
    """A documentation comment without its markers, as one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(doc, r"(?m)^\s*/?\*+/?|\*/\s*$", " "), r"\s+", " "))
