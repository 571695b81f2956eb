"""Materialised tables, bounded broadcasts and joins that survive hot keys.

Everything that is materialised goes below the folder that the session names in
``spark.checkpoint.dir``; executors and driver all see it.  Only a local session without
that setting (unit tests, a laptop) gets a folder below the system's temporary folder; a
cluster without it is an error, as a machine's own folder would lose rows there.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this share of all rows is joined by broadcast.
HOT_SHARE = 1 / 1024
#: Rows of a few fixed-width columns that may be broadcast (about 50 MB once hashed).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and every executor can read and write."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.environ.get("QUILLMARK_SHARED") or os.path.join(tempfile.gettempdir(), "quillmark-shared")
    os.makedirs(path, exist_ok=True)
    return "file://" + path


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh URI below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/quillmark-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table: the plan runs once and the rows outlive executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of ``written`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (fixed-width columns, a written table), to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def weighted_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (unique in ``right``), safe from hot keys.

    ``weight`` says how many rows of ``left`` have the key, ``total`` how many rows there
    are.  Keys above HOT_SHARE of them are 1 / HOT_SHARE at most, whatever the input: they
    are broadcast, and their rows stay where they are; all others are shuffled.  ``left``
    is read twice.  ``how`` is inner or left.
    """
    hot = F.col(weight) > max(1000.0, total * HOT_SHARE)
    many = F.broadcast(right.where(hot))
    few = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti")
    return left.join(many, key).unionByName(few.join(right.where(~hot), key, how))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has it (any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
