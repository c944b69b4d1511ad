"""Session, tables and lineage cuts shared by the whole library."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few ids and numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def session(app: str = "strandweave") -> SparkSession:
    """A session with adaptive execution and skew handling on; resources come from the cluster."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Only Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is
    unset, a local master gets a temporary folder of its own; a cluster gets an error, since its
    executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    own = tempfile.mkdtemp(prefix="strandweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs one re-read instead of the whole history, columns can be pruned
    on the way back, and the bytes are compressed. Spark removes the folder when it exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.parquet(path)


def small_or_not(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows of a written table), marked for broadcast if it was counted to have at
    most BROADCAST_ROWS rows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
