"""Session settings, table access and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def get_spark(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the plans assume; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pressloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = "file://" + tempfile.mkdtemp(prefix="pressloom-")
    return shared_dir.local


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a table to the shared folder and read it back.

    This cuts the lineage, lets several consumers use one computation, and survives lost executors:
    the files lie outside of any executor. They are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pressloom-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mine(spark: SparkSession, path: str) -> None:
    """Marks a folder to be removed with the tables of settle()."""
    _made.append((spark, path))


def _on(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _on(spark, path)
    return fs.exists(p)


def release(since: int = 0) -> None:
    """Remove the tables that settle() wrote, those after the first `since`; call it only once their readers are done."""
    while len(_made) > since:
        spark, path = _made.pop()
        try:
            fs, p = _on(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


@contextmanager
def scratch() -> Iterator[None]:
    """Tables settled inside are removed at the end: for one query or micro-batch whose result is written inside."""
    since = len(_made)
    try:
        yield
    finally:
        release(since)


atexit.register(release)
