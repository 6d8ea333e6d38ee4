"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import class_key, table_key
from codeweft.operators.symbols import latest, living_symbols
from codeweft.session import cut, rows
from codeweft.skew import HOT_MIN_ROWS, HOT_SHARE, salted_join


def orphan_rows(references: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``references`` whose key is not in ``targets``.

    The keys are made distinct first, so the anti-join sees each key once however many rows
    share it; the orphan keys are then joined back, hot ones salted, which their counts tell. A null
    in any key is no reference, repeated rows each count, an empty ``targets`` makes every
    reference an orphan. The references are written once with their keys, as both steps read them.
    """
    references = cut(references.na.drop(subset=keys), "references")
    wanted = references.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    missing = wanted.join(targets.select(*keys).na.drop(subset=keys).distinct(), keys, "left_anti")
    n = rows(references)
    if n <= HOT_MIN_ROWS:
        return references.join(missing.select(*keys), keys, "left_semi")
    missing = cut(missing, "missing")
    return salted_join(references, missing.select(*keys), keys, "left_semi", hot=missing.filter(F.col("_n") > max(HOT_MIN_ROWS, n * HOT_SHARE)).select(*keys))


def _references(parsed_classes: DataFrame, parsed_uses: DataFrame, eloquent_models: DataFrame) -> tuple[DataFrame, DataFrame]:
    month = F.date_format("parsed_at", "yyyy-MM").alias("month")
    classes = parsed_classes.filter(F.col("removed_at").isNull()).select(F.lit("parsed_classes").alias("ref_table"), F.col("class_id").alias("ref_id"), class_key(F.col("extends")).alias("key"), month)
    uses = parsed_uses.select(F.lit("parsed_uses").alias("ref_table"), F.col("use_id").alias("ref_id"), class_key(F.col("fqn")).alias("key"), month)
    models = eloquent_models.select(F.lit("eloquent_models").alias("ref_table"), F.col("model_id").alias("ref_id"), F.col("repo"), table_key(F.col("db_table")).alias("key"), month)
    return classes.unionByName(uses), models


def _targets(parsed_classes: DataFrame, framework_symbols: DataFrame, db_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = living_symbols(parsed_classes).select("key").unionByName(framework_symbols.select(class_key(F.col("fqn")).alias("key")))
    tables = latest(db_tables.select("repo", table_key(F.col("name")).alias("key"), "created_at", "table_id", "dropped_at"), ["repo", "key"], ["created_at", "table_id"], ["dropped_at"])
    return symbols, tables.filter(F.col("dropped_at").isNull()).select("repo", "key")


def code_orphans(parsed_classes: DataFrame, parsed_uses: DataFrame, eloquent_models: DataFrame, framework_symbols: DataFrame, db_tables: DataFrame) -> DataFrame:
    """(ref_table, ref_id, month) of every reference to a class or table that is not there by the end of the data.

    A class reference is looked up among the living symbols of all repos and the framework's; a
    table of a model among its own repo's tables that are not dropped. A model without a repo
    has no tables, so its table is an orphan. Month is null where parsed_at is.
    """
    class_refs, table_refs = _references(parsed_classes, parsed_uses, eloquent_models)
    symbols, tables = _targets(parsed_classes, framework_symbols, db_tables)
    no_repo = table_refs.filter(F.col("repo").isNull() & F.col("key").isNotNull())
    cols = ["ref_table", "ref_id", "month"]
    return (
        orphan_rows(class_refs, symbols, ["key"]).select(*cols)
        .unionByName(orphan_rows(table_refs, tables, ["repo", "key"]).select(*cols))
        .unionByName(no_repo.select(*cols))
    )


def orphan_report(parsed_classes: DataFrame, parsed_uses: DataFrame, eloquent_models: DataFrame, framework_symbols: DataFrame, db_tables: DataFrame) -> DataFrame:
    """(ref_table, month, n_references, n_orphans): references and orphans per referring table and month."""
    class_refs, table_refs = _references(parsed_classes, parsed_uses, eloquent_models)
    every = class_refs.filter(F.col("key").isNotNull()).select("ref_table", "month").unionByName(table_refs.filter(F.col("key").isNotNull()).select("ref_table", "month"))
    found = code_orphans(parsed_classes, parsed_uses, eloquent_models, framework_symbols, db_tables)
    both = every.select("ref_table", "month", F.lit(0).alias("o")).unionByName(found.select("ref_table", "month", F.lit(1).alias("o")))
    return both.groupBy("ref_table", "month").agg(F.sum(1 - F.col("o")).alias("n_references"), F.sum("o").alias("n_orphans"))
