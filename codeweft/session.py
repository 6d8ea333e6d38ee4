"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def build_session(app: str = "codeweft", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODEWEFT_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _drop_own_dirs() -> None:
    for d in _OWN_DIRS:
        shutil.rmtree(d, ignore_errors=True)


atexit.register(_drop_own_dirs)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is the one named by ``spark.checkpoint.dir``. Only a session in local mode without
    that setting gets a folder of its own, deleted at exit; a cluster without it is an error,
    since a folder on one machine would not survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="codeweft-")
    _OWN_DIRS.append(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame, name: str = "step", **also: Column) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage of iterative plans, survives lost executors and gives the optimizer exact
    sizes. The table stays until :func:`discard` or the end of the session's folder. Its rows are
    counted on the way: see :func:`rows`; ``also`` names further aggregates, see :func:`seen`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeweft/{name}-{uuid.uuid4().hex}"
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in also.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeweft_path, out._codeweft_seen = path, watch.get  # noqa: SLF001
    return out


def rows(df: DataFrame) -> int:
    """The number of rows of a table made by :func:`cut`, known without a job."""
    return seen(df, "_rows")


def seen(df: DataFrame, name: str):
    """An aggregate that :func:`cut` took along."""
    return df._codeweft_seen[name]  # noqa: SLF001


def discard(*dfs: DataFrame | None) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_codeweft_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
