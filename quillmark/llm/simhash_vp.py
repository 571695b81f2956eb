"""SimHash near-duplicate detection with a vantage-point forest.

Method
------
1. Fingerprints: 64 majority bits over the XXH64 (seed 42) of all 3-word shingles.
2. Distinct fingerprints only; copies never meet pairwise.
3. A pair at distance <= 3 has one 32-bit half at distance <= 1 (pigeonhole), so one
   vantage-point tree is grown for each half, under the Hamming distance of that half.
   A node holds a vantage point v and a radius m; a fingerprint lives on the inside if
   d(v, x) <= m and on the outside otherwise.  By the triangle bound only those with
   d <= m + 1 on the outside can have a neighbour inside, so only these are sent along as
   guests (and guests descend wherever their ball of radius 1 reaches).
4. A leaf is a shard.  In each shard residents are compared with residents and guests
   under the whole 64 bits, by further vantage-point splits and blocks of XOR/popcount.
   A shard gives a spanning forest of its links, so a group of n near copies costs n
   rows, not n^2.
5. Components of the forest's edges by distributed union-find.

The trees only route; any tree gives the exact result.  They are grown on the driver from a
sample of one fingerprint in ``SPARSE``, ``SAMPLE`` at most, and have a leaf for each SHARD
fingerprints as far as the sample can tell leaves apart.  A leaf that is larger still is
split by further vantage points inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, spanning
from .shared import discard, keep_rows, table, weighted_join, written
from .textkernel import buffers, normalised_words, small_batches, xxh64

MAX_BITS = 3
SHINGLE = 3
#: Fingerprints per leaf of the routing trees, and the share and bound of the sample they grow from.
SHARD, SPARSE, SAMPLE = 512, 16, 1 << 20
#: Below so many comparisons a shard is searched by blocks.
BRUTE = 1 << 21
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
HALF_BITS = MAX_BITS // len(HALVES)

_U = np.uint64


def simhash_batch(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints of a string array (null: empty; no words: zero)."""
    raw, off = buffers(column)
    buffer, start, end, first = normalised_words(raw, off, lower=True)
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    out = np.zeros(len(words), np.uint64)
    texts = np.flatnonzero(count)
    if not len(texts):
        return out
    count = count[texts]
    owner_first = np.cumsum(count) - count
    within = np.arange(count.sum()) - np.repeat(owner_first, count)
    at = np.repeat(first[texts], count) + within
    last = at + np.repeat(np.minimum(words[texts], shingle), count) - 1
    h = xxh64(buffer, start[at], end[last] - start[at])
    # Eight counters to a 64-bit word; a run of 255 cannot overflow them.
    runs = -(-count // 255)
    run_first = np.cumsum(runs) - runs
    seg = np.repeat(owner_first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    ones = np.empty((len(seg), 8, 8), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> _U(j)) & _U(0x0101010101010101), seg)
        ones[:, :, j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(ones.reshape(-1, 64), run_first, axis=0)
    bits = (2 * total > count[:, None]).astype(np.uint8)
    out[texts] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    ids = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fp = simhash_batch(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {ids.dataType.simpleString()}, fp long"
    )


def distance(x: np.ndarray, v, mask) -> np.ndarray:
    return np.bitwise_count((x ^ _U(v)) & _U(mask))


class VantageTree:
    """Routing tree over one part of the bits."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaves: int):
        self.mask, self.radius, self.leaves = mask, radius, 0
        sample = np.unique(sample)
        self.root = self._grow(sample, max(1, -(-len(sample) // max(1, leaves))))

    def _grow(self, x: np.ndarray, size: int):
        if len(x) > max(size, 4):
            best = None
            for v in x[np.linspace(0, len(x) - 1, 5).astype(int)]:  # several vantage points, the cheapest cut
                d = distance(x, v, self.mask).astype(int)
                seen = np.bincount(d, minlength=66)
                inside = np.cumsum(seen)
                for m in range(65):
                    n = inside[m]
                    if 4 * min(n, len(x) - n) >= len(x):
                        guests = seen[m + 1 : m + 1 + self.radius].sum()
                        if best is None or guests < best[0]:
                            best = (guests, int(v), m, d <= m)
            if best is not None and 2 * best[0] < len(x):
                _, v, m, near = best
                return v, m, self._grow(x[near], size), self._grow(x[~near], size)
        self.leaves += 1
        return self.leaves - 1

    def route(self, x: np.ndarray):
        """(leaf, index into x, guest) of every place that each fingerprint goes to."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(x)), np.zeros(len(x), bool))]
        while todo:
            node, idx, guest = todo.pop()
            if not len(idx):
                continue
            if isinstance(node, int):
                out.append((np.full(len(idx), node, np.int32), idx, guest))
                continue
            v, m, inner, outer = node
            d = distance(x[idx], v, self.mask).astype(int)
            near = d <= m
            inside = d <= m + self.radius
            outside = np.where(guest, d > m - self.radius, ~near)
            todo.append((inner, idx[inside], (guest | ~near)[inside]))
            todo.append((outer, idx[outside], guest[outside]))
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def shard_links(home: np.ndarray, guest: np.ndarray, mask: int, radius: int, bits: int = MAX_BITS):
    """Links (i, j) that span every component of 'home-home and home-guest pairs within bits'.

    Indices count homes first, then guests.  Splits by vantage points while that prunes,
    then compares blocks.
    """
    every = np.concatenate([home, guest])
    n = len(home)
    found_i, found_j = [], []
    todo = [(np.arange(n), np.arange(n, len(every)))]
    rng = np.random.default_rng(7)
    while todo:
        h, g = todo.pop()
        if len(h) * (len(h) + len(g)) > BRUTE:
            v = every[h[rng.integers(len(h))]]
            dh, dg = distance(every[h], v, mask).astype(int), distance(every[g], v, mask).astype(int)
            m = int(np.median(dh))
            m -= int(m == dh.max())
            far = h[dh > m]
            lent = h[(dh > m) & (dh <= m + radius)]
            if 0 < len(far) < len(h) and 2 * len(lent) < len(h):
                todo.append((h[dh <= m], np.concatenate([lent, g[dg <= m + radius]])))
                todo.append((far, g[dg > m - radius]))
                continue
        others = np.concatenate([h, g])
        step = max(1, BRUTE // max(1, len(others)))
        for k in range(0, len(h), step):
            rows = h[k : k + step]
            i, j = np.nonzero(np.bitwise_count(every[rows][:, None] ^ every[others][None, :]) <= bits)
            i, j = rows[i], others[j]
            keep = i != j
            i, j = i[keep], j[keep]
            if len(i) > 2 * len(others):  # many links: their spanning forest is enough
                label = spanning(len(every), i, j)
                i = np.flatnonzero(label != np.arange(len(every)))
                j = label[i]
            found_i.append(i)
            found_j.append(j)
    if not found_i:
        return np.zeros(0, int), np.zeros(0, int)
    label = spanning(len(every), np.concatenate(found_i), np.concatenate(found_j))
    i = np.flatnonzero(label != np.arange(len(every)))
    return i, label[i]


def near_links(distinct_fp: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at distance <= 3.

    ``distinct_fp`` has a column fp without repeats (a written table: it is read twice).
    """
    total = distinct_fp.count()
    share = min(1 / SPARSE, SAMPLE / max(1, total))
    drawn = distinct_fp.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    sample = np.array([r[0] for r in drawn.select("fp").collect()], dtype=np.int64).view(np.uint64)
    leaves = -(-total // SHARD)
    trees = [VantageTree(sample, mask, HALF_BITS, leaves) for mask in HALVES]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.asarray(batch.column(0))
            for k, tree in enumerate(trees):
                leaf, idx, guest = tree.route(signed.view(np.uint64))
                yield pa.record_batch(
                    [pa.array(leaf * len(trees) + k), pa.array(signed[idx]), pa.array(guest)],
                    names=["shard", "fp", "guest"],
                )

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fp, guest = pdf["fp"].to_numpy(), pdf["guest"].to_numpy()
        fp = np.concatenate([fp[~guest], fp[guest]])
        k = int((~guest).sum())
        u = fp.view(np.uint64)
        i, j = shard_links(u[:k], u[k:], HALVES[int(key[0]) % len(trees)], HALF_BITS)
        return pd.DataFrame({"a": fp[i], "b": fp[j]})

    return (
        distinct_fp.select("fp")
        .mapInArrow(route, "shard int, fp long, guest boolean")
        .groupBy("shard")
        .applyInPandas(link, "a long, b long")
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, component_id, head): head is (id is null, id, fp) of the row that stays."""
    fps = written(fingerprints(docs, id_col, text_col), "fp")
    total = fps.count()
    least = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("fp"))).alias("least")
    reps = written(fps.groupBy("fp").agg(least, F.count("*").alias("n")), "reps")
    roots = written(connected_components(near_links(reps.select("fp"))), "roots")
    linked = roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "least")
    merged = linked.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("m"))
    linked = weighted_join(linked, merged, "root", "m", total).select("fp", "head")
    label = reps.join(linked, "fp", "left").select("fp", F.coalesce("head", "least").alias("head"), "n")
    label = written(label, "label")
    discard(reps, roots)
    return weighted_join(fps, label, "fp", "n", total).select("id", "fp", F.col("head.id").alias("component_id"), "head")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id linked, directly or not.

    One row per input row.  Null text counts as empty; texts without a word have
    fingerprint zero and link like any others.  Repeated rows share their component.
    Null ids keep their row and are ignored for component_id unless all are null.
    Other columns, whatever their names, are not touched.  An empty table gives no rows.
    """
    return _labelled(docs, id_col, text_col).drop("head")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one document per component: that with the smallest id (nulls last).

    All columns stay.  Ids may be null or stand for several texts: a row is known by id and
    fingerprint, and of rows that repeat both one stays.
    """
    judged = _labelled(docs, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("fp") == F.col("head.fp"))
    judged = written(judged.select("id", F.col("fp").alias("mark"), stays.alias("kept")), "judged")

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash_batch(pa.array(texts, pa.string())).view(np.int64))

    return keep_rows(docs, id_col, judged, lambda df, name: df.withColumn(name, fingerprint(F.col(text_col).cast("string"))))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
