"""Session helpers: building a session, the shared scratch folder, shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "docflow", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the queries need (UTC, AQE, Arrow); a local one only where cpus is given, as in tests and
    bench.py. Otherwise master, memory and shuffle partitions are those of spark-submit."""
    builder = SparkSession.builder.appName(app)
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        shuffle_partitions = shuffle_partitions or cpus
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all runs in one machine (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="docflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_scopes: list[list[tuple[str, str | None]]] = []


def _made(path: str, keep: bool, table: str | None = None) -> None:
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append((path, table))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end, but for what is kept; that belongs to the scope around, if there is one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path, table in _scopes.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it back.

    A reader of the result depends on shared files only, so a lost executor costs nothing that was finished.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/docflow/{name}-{uuid.uuid4().hex}"
    _made(path, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """As many as shuffle partitions; with fewer, Spark would deal a bucketed table out again."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize, but in buckets by key: what is dealt out by key is joined to it without moving it."""
    spark = df.sparkSession
    table = f"docflow_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/docflow/{table}"
    _made(path, False, table)
    df.write.bucketBy(bucket_count(spark), key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what materialize wrote, once no result that reads it is needed any more."""
    _delete(spark, f"{checkpoint_dir(spark)}/docflow")
    for table in spark.catalog.listTables(pattern="docflow_*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="docflow-ship-"), "docflow_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
