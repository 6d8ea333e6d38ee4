"""Keeping tables fresh: file streams, replacement by key, work chosen by path, debounced recomputation.

Streams over event time with watermarks are an addition of this engine; the rest mirrors a watch
loop over a source tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.symbols import latest

#: Steps that every changed file of code needs, those by where it lies, those of files that are more than code, and those of the whole graph.
BASE_STEPS = ("parse", "imports", "calls", "heritage", "types", "config", "injections", "contracts", "contracts_of_code", "http_calls", "notifications")
STEPS_BY_PATH = (("app/Models/", ("relations", "table_links", "db_access", "query_risks")), ("app/Events/", ("events",)), ("app/Listeners/", ("events",)), ("app/Jobs/", ("events",)))
OWN_STEPS = (("routes/", ("routes", "middleware")), ("database/migrations/", ("schema",)))
GLOBAL_STEPS = ("communities", "flows", "dead_code")


def changed_files(spark: SparkSession, folder: str, schema: T.StructType | str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def steps_for(changes: DataFrame, path: str = "path") -> DataFrame:
    """(path, step): what to run again for each changed file.

    Route files and migrations have steps of their own, templates one; other php files need the base
    steps and those of their folder. Other files need none. The steps of the whole graph
    (:data:`GLOBAL_STEPS`) wait for a quiet moment and belong to no file.
    """
    words = lambda steps: F.array(*[F.lit(s) for s in steps]).cast("array<string>")
    at = F.concat(F.lit("/"), F.col(path))
    wanted = words(BASE_STEPS)
    for prefix, steps in STEPS_BY_PATH:
        wanted = F.concat(wanted, F.when(at.contains(f"/{prefix}"), words(steps)).otherwise(words(())))
    out = F.when(at.endswith(".blade.php"), words(("templates",)))
    for prefix, steps in OWN_STEPS:
        out = out.when(at.contains(f"/{prefix}") & at.endswith(".php"), words(steps))
    out = out.when(at.endswith(".php"), wanted).otherwise(words(()))
    return changes.select(path, F.explode(F.array_distinct(out)).alias("step"))


def merged(table: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the rows of a batch in place of those of the same keys; within the batch the latest row holds."""
    new = latest(batch, keys, order, [c for c in batch.columns if c not in keys]).select(*batch.columns)
    return new if table is None else table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


#: Parts into which a merged table is cut by a hash of its keys.
BUCKETS = 64


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """Bucket -> the version that holds it after batch ``n``; at most BUCKETS entries."""
    if n < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").json(f"{path}/versions/v={n}").collect()}


def current(spark: SparkSession, path: str, schema: T.StructType | str, n: int | None = None) -> DataFrame:
    """The merged table as of batch ``n``, by default the last one."""
    if n is None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        n = max((int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p)), default=-1) if fs.exists(p) else -1
    at = [f"{path}/rows/v={v}/bucket={b}" for b, v in sorted(_versions(spark, path, n).items())]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def merge_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, after: Callable[[DataFrame], None] | None = None, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Merges a stream into a table by keys, batch by batch; ``after`` sees the table after each batch.

    The table lies in :data:`BUCKETS` parts by a hash of the keys, of which a batch reads and writes
    anew only those that it touches, under its own number; a list of what version holds each part
    is written last, so a batch that is replayed starts from the list before and counts once. What
    neither the new list nor the one before names is deleted. Read with :func:`current`. ``every``
    is the debounce of what ``after`` recomputes when the stream keeps running.
    """
    schema = stream.schema

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = _versions(spark, path, n - 1)
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")
        batch = batch.persist()
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        at = [f"{path}/rows/v={held[b]}/bucket={b}" for b in touched if b in held]
        old = spark.read.schema(schema).parquet(*at) if at else None
        merged(old, batch, keys, order).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={n}")
        batch.unpersist()
        now = {**held, **{b: n for b in touched}}
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{path}/versions/v={n}")
        _drop_unnamed(spark, path, n, {*held.items(), *now.items()})
        if after:
            after(current(spark, path, schema, n))

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def _drop_unnamed(spark: SparkSession, path: str, n: int, named: set[tuple[int, int]]) -> None:
    """Deletes parts of the batches before ``n`` that no list in use names, and lists before the last two."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(p(f"{path}/rows")):
        v = int(f.getPath().getName().split("=")[1])
        parts = [x for x in fs.listStatus(f.getPath()) if x.getPath().getName().startswith("bucket=")]
        gone = [x for x in parts if (int(x.getPath().getName().split("=")[1]), v) not in named]
        if v <= n and len(gone) == len(parts):
            fs.delete(f.getPath(), True)
        else:
            for x in gone:
                fs.delete(x.getPath(), True)
    for f in fs.listStatus(p(f"{path}/versions")):
        if int(f.getPath().getName().split("=")[1]) < n - 1:
            fs.delete(f.getPath(), True)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, group, n) of events, late ones counted until the watermark has passed."""
    at = F.col(time).cast("timestamp")
    return stream.withColumn("_t", at).withWatermark("_t", late).groupBy(F.window("_t", width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), group, "n")
