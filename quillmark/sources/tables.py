"""Table scans and record sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _parsed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, line, row): every line that is not blank; row._bad holds a line that is no record."""
    whole = T.StructType([*_fields(schema).fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    return lines.withColumn("row", F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, line): lines that are no object of the schema; blank lines are none."""
    return _parsed(spark, path, schema).where("row IS NULL OR row._bad IS NOT NULL").select("file", "line")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON Lines with a fixed schema; a malformed line, which is named, or a blank required field fails the job."""
    ok = F.col("row").isNotNull() & F.col("row._bad").isNull()
    fail = F.raise_error(F.concat(F.lit("not a record: "), "line")).cast("boolean")
    df = _parsed(spark, path, schema).where(F.when(ok, True).otherwise(fail)).select("row.*").drop("_bad")
    for name in required:
        blank = F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""
        df = df.withColumn(name, F.when(blank, F.raise_error(F.lit(f"blank {name}"))).otherwise(F.col(name)))
    return df


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...], key: str = "id") -> DataFrame:
    """``read_jsonl`` that also fails on an empty file and on a repeated key."""
    df = read_jsonl(spark, path, schema, required)
    again = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    if again is None:
        raise ValueError(f"no records in {path}")
    if again["n"] > 1:
        raise ValueError(f"repeated {key}: {again[key]}")
    return df


def read_split(spark: SparkSession, path: str, schema: T.StructType | str, split: str, key: str = "id") -> DataFrame:
    """Records of one split; a record of another split fails the job."""
    df = read_jsonl(spark, path, schema, (key, "split"))
    wrong = F.raise_error(F.concat(F.lit("a record of another split: "), F.col(key).cast("string"))).cast("boolean")
    return df.where(F.when(F.col("split") == split, True).otherwise(wrong))


def read_catalog(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """CSV catalog, all strings, keyed by prefix and number; a byte-order mark at its start is no part of a name."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    return df.withColumn("source_id", F.concat(F.lit(prefix), F.col(f"`{key}`")))


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def mismatches(manifest: DataFrame, locked: DataFrame) -> DataFrame:
    """Locked (path, sha256) rows that the manifest lacks or contradicts."""
    found = manifest.select("path", F.col("sha256").alias("actual"))
    return locked.join(found, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def accepted_artifacts(manifest: DataFrame, locked: DataFrame) -> DataFrame:
    """The manifest's rows, provided that every locked file is there and unchanged; else the job fails."""
    wrong = mismatches(manifest, locked).limit(1).select(F.raise_error(F.concat(F.lit("changed or missing: "), "path")).cast("string").alias("path"))
    return manifest.join(wrong, "path", "left_anti")
