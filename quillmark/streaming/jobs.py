"""Streaming twins of batch operators; each takes and returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def first_copies(stream: DataFrame, at: str, late: str = "1 hour", text: str = "text") -> DataFrame:
    """The first row of each normalised text; a text's hash is kept until the watermark passes it."""
    return stream.withColumn("text_hash", X.text_hash(F.col(text))).withWatermark(at, late).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n): rows a tumbling window and key; rows behind the watermark are left out."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, width), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def contaminated(stream: DataFrame, reference: DataFrame, width: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shingle) rows of a stream whose shingles a static reference has."""
    words = X.words(F.col(text)).alias("_words")
    shingles = F.explode(X.shingles(F.col("_words"), width)).alias("shingle")
    known = reference.select(words).select(shingles).distinct()
    return stream.select(key, words).select(key, shingles).join(known, "shingle", "left_semi")
