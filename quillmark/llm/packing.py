"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Method
------
1. Texts become token ids (one closing id each) and are cut at every ``CONTEXT`` ids.
   Only (document, start, length, checksum) leave the tokenizing task, with the task's
   number and the piece's rank among its pieces of that length.
2. The histogram has at most CONTEXT bins, whatever the corpus.  Lengths are placed
   longest first: pieces of one length go to the shortest open packing pattern, that with
   the most room, whole pattern counts at a time; what fits none opens new patterns.
3. Patterns lead back to documents by rank: the i-th piece of a length (task offsets plus
   rank in the task) takes the i-th slot of that length over all patterns.

What is broadcast is bounded by the number of bins: histogram, patterns and slot ranges.
The ranks' offsets, one row a task and length, are joined by a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written
from .textkernel import small_batches

CONTEXT = 1024
TOKENIZER = "byte_bpe_50k"
END_ID = 0
#: Distinct chunks of text whose ids a worker remembers.
REMEMBERED = 400_000

_loaded: dict = {}


class Encoder:
    """Ids of ``public_tokenizers`` vocabularies as little-endian unsigned 32-bit bytes.

    The vocabulary's own pattern never lets a token cross the border before a single
    space or around a single line feed, so texts whose white space is single spaces and
    line feeds are encoded chunk by chunk from memory.  Any other text, and one that
    holds a special token's string, goes through the tokenizer as a whole.
    """

    _plain = re.compile(r"[^\S \n]|[ \n]{2}|\x00|[ \n]\Z|<\|")

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        class Memory(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = np.array(encoding.encode_ordinary(chunk), "<u4").tobytes()
                if len(self) < REMEMBERED and len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self.memory = Memory()

    def __call__(self, text: str) -> bytes:
        if self._plain.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return b"".join(map(self.memory.__getitem__, chunks))


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]


def shortest_pack_first(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, how often)]: pattern is ((length, copies), ...), lengths descending.

    Longest lengths first; a length goes to the shortest open patterns (those with the most
    room), one piece to each, moving whole counts; what no open pattern has room for opens
    new ones.
    """
    packs: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(context + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], context
        while left and room >= length:
            if not packs[room]:
                room -= 1
                continue
            pattern, times = packs[room].popitem()
            used = min(times, left)
            if used < times:
                packs[room][pattern] = times - used
            longer = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            inside = packs[room - length]
            inside[longer] = inside.get(longer, 0) + used
            left -= used
        if left:
            # A new pattern is the shortest open one until it is as full as the others, here: full.
            fit = context // length
            if left // fit:
                packs[context - fit * length][((length, fit),)] = left // fit
            if left % fit:
                packs[context - left % fit * length][((length, left % fit),)] = 1
    merged: dict[tuple, int] = {}
    for inside in packs:
        for pattern, times in inside.items():
            merged[pattern] = merged.get(pattern, 0) + times
    return sorted(merged.items(), reverse=True)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, task, rank), written once."""
    ids_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(context + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in small_batches(batches, 4 << 20):
            row, start, length, crc, total, rank = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                raw = encode(text or "") + end
                n = len(raw) // 4
                for at in range(0, n, context):
                    size = min(context, n - at)
                    row.append(r)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    total.append(n)
                    rank.append(int(seen[size]))
                    seen[size] += 1
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), long(start), long(length), long(crc), long(total), long([task] * len(row)), long(rank)],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"],
            )

    return written(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            run, f"id {ids_type}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"
        ),
        "pieces",
    )


def slot_ranges(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, copies, first_sequence, offset): ranks low..high-1 of a length
    fill ``copies`` slots a sequence from ``first_sequence`` on, the first at ``offset``."""
    ranges, upto, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            low = upto.get(length, 0)
            upto[length] = low + copies * times
            ranges.append((length, low, upto[length], copies, sequence, offset))
            offset += length * copies
        sequence += times
    return ranges


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Null text counts as empty; an empty text is one piece of one id.  Repeated rows and
    null ids are packed like any others; other columns are ignored; an empty table gives
    no rows.  A sequence's pieces lie gapless from offset 0.
    """
    spark = docs.sparkSession
    cut = pieces(docs, id_col, text_col, context, tokenizer)
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    counts = written(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = slot_ranges(shortest_pack_first(histogram, context))
    names = "length long, low long, high long, copies long, first long, at long"
    placed = cut.join(counts.drop("n").hint("merge"), ["task", "length"]).withColumn("i", F.col("rank") + F.col("before"))
    slots = F.broadcast(spark.createDataFrame(ranges, names))
    placed = placed.join(slots, "length").where("i >= low AND i < high")
    return placed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("first + (i - low) div copies").alias("sequence_id"),
        F.expr("at + ((i - low) % copies) * length").alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
