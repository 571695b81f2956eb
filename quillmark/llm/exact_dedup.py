"""Exact deduplication: counting quotient filters, then byte verification.

Method
------
1. Text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null is empty)
   and given a 64-bit fingerprint (XXH64) and a SHA-256 digest.
2. Every partition builds counting quotient filters of its fingerprints, one for each
   range of leading bits, each with as many quotients as it has fingerprints.  Quotient
   and remainder together are the whole fingerprint, so a filter loses nothing, and
   filters of one range merge by walking their sorted remainders and adding counts.  A
   group of n copies is one counter in each partition.
3. Fingerprints with a count above one route their documents to byte verification: the
   routed texts are grouped by their bytes (partial aggregation: a hot text leaves each
   task once), which gives the smallest id and the size of every group.
4. All others stay without having met.

Filters have bytes in proportion to their fingerprints, whatever the corpus, and a range
holds about RANGE of them, so neither a task's nor a merge's memory grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, bounded, keep_rows, table, weighted_join, written

#: Fingerprints that a task gathers before it emits filters, and those aimed at per range.
FLUSH, RANGE = 1 << 20, 1 << 17
LEAST_RANGE_BITS = 5


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints of which the top ``skip`` bits are fixed.

    The next ``q`` bits are the quotient: bit i of ``occupied`` tells that slot run i is
    there, bit j of ``run_end`` that slot j ends a run.  Slots hold sorted remainders of
    64 - skip - q bits, beside their counters.
    """

    def __init__(self, occupied: np.ndarray, run_end: np.ndarray, remainder: np.ndarray, count: np.ndarray, prefix: int, skip: int, q: int):
        self.occupied, self.run_end, self.remainder, self.count = occupied, run_end, remainder, count
        self.prefix, self.skip, self.q = prefix, skip, q

    @classmethod
    def build(cls, sorted_fp: np.ndarray, count: np.ndarray, prefix: int, skip: int) -> CountingQuotientFilter:
        """``sorted_fp``: distinct, ascending, all with the same leading ``skip`` bits."""
        q = min(64 - skip, max(3, len(sorted_fp).bit_length()))
        r = 64 - skip - q
        quotient = ((sorted_fp >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.ones(len(sorted_fp), bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        return cls(occupied, run_end, sorted_fp & np.uint64((1 << r) - 1), count.astype(np.int64), prefix, skip, q)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints ascending, counts): the multiset, exactly."""
        r = 64 - self.skip - self.q
        run = np.cumsum(self.run_end) - self.run_end
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        top = np.uint64((self.prefix << (64 - self.skip)) & (2**64 - 1)) if self.skip else np.uint64(0)
        return top | (quotient << np.uint64(r)) | self.remainder, self.count

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Lossless union: both are walked in the order of quotient and remainder."""
        if (self.prefix, self.skip) != (other.prefix, other.skip):
            raise ValueError("filters of different ranges don't merge")
        (a, m), (b, n) = self.items(), other.items()
        at = np.searchsorted(a, b)
        same = np.zeros(len(b), bool)
        inside = at < len(a)
        same[inside] = a[at[inside]] == b[inside]
        count = m.copy()
        count[at[same]] += n[same]
        return self.build(np.insert(a, at[~same], b[~same]), np.insert(count, at[~same], n[~same]), self.prefix, self.skip)

    def dumps(self) -> bytes:
        head = np.array([self.prefix, self.skip, self.q, len(self.remainder)], "<i8").tobytes()
        width = 4 if 64 - self.skip - self.q <= 32 else 8
        big = self.count.max(initial=0) > 255
        return b"".join([
            head, bytes([width, int(big)]), np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(),
            self.remainder.astype(f"<u{width}").tobytes(), self.count.astype("<i8" if big else "<u1").tobytes(),
        ])

    @classmethod
    def loads(cls, raw: bytes) -> CountingQuotientFilter:
        prefix, skip, q, n = (int(x) for x in np.frombuffer(raw, "<i8", 4))
        width, big, at = raw[32], raw[33], 34
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, -(-(1 << q) // 8), at), count=1 << q).astype(bool)
        at += -(-(1 << q) // 8)
        run_end = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        remainder = np.frombuffer(raw, f"<u{width}", n, at).astype(np.uint64)
        count = np.frombuffer(raw, "<i8" if big else "<u1", n, at + n * width).astype(np.int64)
        return cls(occupied, run_end, remainder, count, prefix, skip, q)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{SPACES}+", " ")


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n): the fingerprints that occur more than once, by merged filters.

    ``fps`` has one long column fp and is a written table.
    """
    total = fps.count()
    skip = max(LEAST_RANGE_BITS, int(np.ceil(np.log2(max(2, total / RANGE)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def filters():
            fp, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            prefix = (fp >> np.uint64(64 - skip)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(prefix, prepend=-1)), len(fp))
            made = [
                CountingQuotientFilter.build(fp[i:j], count[i:j], int(prefix[i]), skip)
                for i, j in zip(cuts, cuts[1:], strict=False)
            ]
            return pa.record_batch(
                [pa.array([f.prefix for f in made], pa.int32()), pa.array([f.dumps() for f in made], pa.binary())], names=["shard", "filter"]
            )

        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield filters()
        if sum(map(len, held)):
            yield filters()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[CountingQuotientFilter] = []
        for raw in pdf["filter"]:  # like sizes merge, so that each item is moved log n times
            found.append(CountingQuotientFilter.loads(raw))
            while len(found) > 1 and len(found[-2].count) <= len(found[-1].count):
                found.append(found.pop().merge(found.pop()))
        while len(found) > 1:
            found.append(found.pop().merge(found.pop()))
        fp, count = found[0].items()
        more = count > 1
        return pd.DataFrame({"fp": fp[more].view(np.int64), "n": count[more]})

    return fps.select("fp").mapInArrow(build, "shard int, filter binary").groupBy("shard").applyInPandas(merge, "fp long, n long")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, keep_id, group_size, kept) of every row; see ``duplicate_groups``."""
    norm = normalised(F.col(text_col))
    marks = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    marks = marks.select("id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.xxhash64("norm").alias("fp"))
    marks = written(marks.withColumn("row", F.monotonically_increasing_id()), "marks")
    total = marks.count()
    again = written(repeated_fingerprints(marks), "again").select("fp")
    routed = written(marks.join(again, "fp", "left_semi"), "routed")
    # Routed texts meet by their bytes; only they are normalised again.
    ids = written(routed.select(F.col("id").alias("routed_id")).distinct(), "ids")
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = raw.join(bounded(ids), raw["id"].eqNullSafe(ids["routed_id"]), "left_semi").select("id", normalised(F.col("text")).alias("norm"))
    verified = texts.groupBy("norm").agg(F.count("*").alias("group_size")).where("group_size > 1")
    verified = verified.select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "group_size")
    # Of a group the row of the smallest id stays, of rows that repeat that id the first.
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("first")
    heads = routed.groupBy("sha").agg(first).join(verified, "sha").select("sha", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    heads = written(heads, "verified")
    out = weighted_join(marks.select("id", "sha", "row"), heads, "sha", "group_size", total, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, keep_id, group_size, kept), one row per row of ``docs``.

    Texts are equal when their normalised bytes are; null counts as empty, and empty
    texts equal each other.  Of equal texts the smallest id stays (null ids come last);
    of rows that repeat both id and text exactly one is kept.  Other columns are ignored
    and may have any name.  An empty table gives no rows.
    """
    return _judged(docs, id_col, text_col).withColumnRenamed("sha", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one row for each distinct normalised text; all columns stay."""
    judged = written(_judged(docs, id_col, text_col).select("id", F.col("sha").alias("mark"), "kept"), "judged")
    return keep_rows(docs, id_col, judged, lambda df, name: df.withColumn(name, F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
