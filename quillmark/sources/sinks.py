"""Sinks: JSON Lines in the canonical dialects, small JSON files, packed streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C


def write_jsonl(df: DataFrame, path: str, fields: dict[str, tuple[Column, str]], canonical: bool = True) -> None:
    """One JSON object a row (see ``canonical``), committed by Spark as a folder of text files.

    ``canonical`` sorts keys and writes ASCII; else keys keep their order and text stays UTF-8.
    """
    line = C.canonical_json(fields) if canonical else F.rtrim(C.json_line(fields), F.lit("\n"))
    df.select(line.alias("value")).write.text(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file (sorted keys, indented), written under another name and then renamed."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(part, True)
    out.write(bytearray((json.dumps(value, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"could not move {part} to {path}")


def write_schedule(schedule: DataFrame, path: str, order: str = "ordinal") -> str:
    """A schedule as Parquet with its digest beside it; returns the digest of its lines in order."""
    from ..operators.records import file_fingerprint

    schedule.write.parquet(f"{path}/entries")
    back = schedule.sparkSession.read.parquet(f"{path}/entries")
    line = F.to_json(F.struct(*sorted(back.columns)), {"ignoreNullFields": "false"})
    row = file_fingerprint(back.select(order, line.alias("line")), "line", order).first()
    write_json(schedule.sparkSession, f"{path}/schedule.json", {"entries": row["lines"], "sha256": row["sha256"]})
    return row["sha256"]


def write_packed(df: DataFrame, path: str, split: str = "split") -> None:
    """Packed token rows (split, start_offset, ...) in one folder a split, rows in order inside a file."""
    df.sortWithinPartitions(split, "start_offset").write.partitionBy(split).parquet(path)
