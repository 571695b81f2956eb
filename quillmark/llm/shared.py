"""Words, tables and files shared by the operators; materialisation lives in ``plans.scratch``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import bounded, discard, free_name, scratch, shared_dir, weighted_join, written

__all__ = ["SPACES", "WORD", "Folder", "bounded", "discard", "free_name", "keep_rows", "scratch", "shared_dir", "table", "weighted_join", "written"]

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(docs: DataFrame, id_col: str, judged: DataFrame, marked) -> DataFrame:
    """Rows of ``docs`` that ``judged`` keeps, all columns unchanged.

    ``judged`` (a written table) has (id, mark, kept) for every row of ``docs``.  Where an id
    is not null and stands for one row, its verdict is the row's, and texts are shuffled by
    id only if more ids are lost than may be broadcast.  Rows whose id is null or repeated
    are told apart by ``mark``, which ``marked(df, name)`` adds to them; those that repeat
    both are one row.
    """
    of, mark = free_name(docs, "kept_of"), free_name(docs, "kept_mark")
    several = judged.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias(of))
    several = written(several, "several")
    among = lambda df, how: df.join(bounded(several), df[id_col].eqNullSafe(several[of]), how)
    lost = written(judged.where(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias(of)).distinct(), "lost")
    if several.isEmpty():
        return docs.join(bounded(lost), docs[id_col] == lost[of], "left_anti")
    single = among(docs, "left_anti")
    single = single.join(bounded(lost), single[id_col] == lost[of], "left_anti")
    again = marked(among(docs, "left_semi"), mark)
    kept = judged.where("kept").select(F.col("id").alias(of), F.col("mark").alias("of_mark")).distinct()
    again = again.join(kept, again[id_col].eqNullSafe(kept[of]) & (again[mark] == kept["of_mark"]), "left_semi")
    return single.union(again.dropDuplicates([id_col, mark]).drop(mark))


class Folder:
    """Files in the shared folder, opened by workers.

    A ``file:`` folder is used in place; any other scheme goes through pyarrow's
    filesystems.  ``write`` is atomic and idempotent (temporary name, then rename), so a
    task that is retried or run twice leaves the same file.  ``mapped`` memory-maps a
    file; a remote one is first copied to an unlinked local file, so nothing stays
    behind on the worker's disk.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri[len("file:"):] if uri.startswith("file:") else uri if "://" not in uri else None
        if self.local is not None:
            self.local = "/" + self.local.lstrip("/")

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, chunks) -> int:
        size = 0
        part = f"{name}.{uuid.uuid4().hex}.part"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(os.path.join(self.local, part), "wb") as out:
                for c in chunks:
                    size += out.write(c)
            os.replace(os.path.join(self.local, part), os.path.join(self.local, name))
            return size
        system, path = self._remote()
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{part}") as out:
            for c in chunks:
                out.write(c)
                size += memoryview(c).nbytes
        system.move(f"{path}/{part}", f"{path}/{name}")
        return size

    def mapped(self, name: str):
        """The file's bytes as a read-only memory map (an empty file gives empty bytes)."""
        import mmap

        if self.local is not None:
            with open(os.path.join(self.local, name), "rb") as f:
                if os.fstat(f.fileno()).st_size == 0:
                    return b""
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        system, path = self._remote()
        with tempfile.TemporaryFile() as f:
            with system.open_input_stream(f"{path}/{name}") as src:
                while block := src.read(1 << 22):
                    f.write(block)
            f.flush()
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
