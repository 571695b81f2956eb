"""Interpolated modified Kneser-Ney language model of order three, counted in Spark.

Method
------
1. Words of the training texts are hashed to 64 bits (XXH64) and counted; the sorted hash
   array of each range of leading bits is one file of the shared folder.  A word's id is
   its rank over all ranges, so every further array is one of sorted ranks of hashes.
2. Trigrams (u, v, w) are counted in bounded runs, sent as sorted, compressed blocks to
   shards by their middle word v and merged there.  So a shard holds whole contexts (u, v)
   and all trigrams from which a bigram (v, w) gets its adjusted count, the number of
   different u.  A middle word that a shard could not hold is dealt by (u, v), the text's
   start by (v, w); the adjusted counts of these are summed by (v, w) in a second step.
3. Totals and counts of counts of the one-word contexts, and the number of words v that w
   follows, are summed per word.
4. Workers memory-map the arrays and look up whole batches at once:

     p(w | u v) = max(c(u v w) - D3(c), 0) / c(u v .) + g(u v) p(w | v)
     p(w | v)   = max(a(v w) - D2(a), 0) / a(v .) + g(v) p(w)
     p(w)       = max(a(w) - D1(a), 0) / a(.) + g / (V + 1)

   c are counts; a are adjusted counts (numbers of different words before), but counts
   where the first word is the text's start.  Each order has the modified discounts for
   counts 1, 2 and 3 or more.  A text's first word has only its start as context, its end
   is a token; the last term leaves the unknown word its share.

The driver holds a few sums and the ids of the words dealt otherwise, fewer than there are
shards.  Files are written under a temporary name and renamed, so a repeated task leaves
the same file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Folder, discard, scratch, table, written
from .textkernel import buffers, normalised_words, small_batches, xxh64

FOLDS, HELD_OUT = 7, 2
#: Tokens counted before a block is emitted (below 2^21, see ``_counted``), and tokens aimed at per shard.
RUN, SHARD = 1_500_000, 3_000_000
LEAST_SHARDS = 32
#: Characters of training text for each range of the vocabulary.
RANGE = 64 << 20
#: Contexts with so many followers have their sums stored; those of others are made when asked for.
HEAVY = 16
#: Files that a worker keeps mapped.
MAPPED = 4096

_U = np.uint64
# A space is in no word, so these are no word's bytes.
_END = int(xxh64(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))[0])


@dataclass
class Model:
    uri: str
    bits: int  # of a vocabulary range
    first_id: np.ndarray  # first id of each range, and V at the end
    tokens: int
    shards: int
    hot: np.ndarray  # sorted ids of words dealt by (u, v); the last is V, the text's start
    discounts: tuple[tuple[float, float, float], ...]  # of orders 1 to 3
    mass: float  # what order 1 leaves to the unknown word's share
    continuations: int

    @property
    def types(self) -> int:
        return int(self.first_id[-1])


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def _sequences(column: pa.Array):
    """(token hashes with one end a text, first token of each text and the total)."""
    raw, off = buffers(column)
    buffer, start, end, first = normalised_words(raw, off, lower=True)
    at = first + np.arange(len(first))  # one more token for each text before
    out = np.full(int(at[-1]), _END, np.uint64)
    place = np.ones(len(out), bool)
    place[at[1:] - 1] = False
    out[place] = xxh64(buffer, start, end - start)
    return out, at


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "shard" else pa.binary() for n in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _cuts(sorted_shard: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.diff(sorted_shard, prepend=-1)), len(sorted_shard))


_ZSTD = "zstd"


def _squeeze(array: np.ndarray) -> bytes:
    """Little-endian bytes, plane by plane, compressed; the length goes before."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec(_ZSTD, 1).compress(planes, asbytes=True)


def _expand(raw: bytes, dtype: str = "<u8") -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.Codec(_ZSTD).decompress(raw[8:], size, asbytes=True), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


class Arrays:
    """Memory-mapped arrays of one model in a worker."""

    _now: Arrays | None = None

    def __init__(self, uri: str):
        self.uri, self.folder, self.maps = uri, Folder(uri), {}

    @classmethod
    def of(cls, uri: str) -> Arrays:
        if cls._now is None or cls._now.uri != uri:
            cls._now = cls(uri)
        return cls._now

    def find(self, name: str) -> dict[str, np.ndarray] | None:
        """The arrays, or None if no such file was written."""
        try:
            return self.get(name)
        except FileNotFoundError:
            return None

    def get(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.maps:
            while len(self.maps) >= MAPPED:
                del self.maps[next(iter(self.maps))]
            raw = self.folder.mapped(name)
            size = int(np.frombuffer(raw, "<u8", 1)[0])
            fields = json.loads(raw[8 : 8 + size])
            self.maps[name] = {f: np.frombuffer(raw, dtype, n, at + 8 + size) for f, dtype, n, at in fields}
        return self.maps[name]


def _save(uri: str, name: str, **arrays: np.ndarray) -> None:
    """One file: a list of (name, type, length, place), then the arrays, each at a multiple of eight."""
    fields, at, parts = [], 0, []
    for field, a in arrays.items():
        fields.append((field, a.dtype.str, len(a), at))
        raw = a.tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    head = json.dumps(fields).encode()
    head += b" " * (-len(head) % 8)
    Folder(uri).write(name, [len(head).to_bytes(8, "little"), head, *parts])


def _counts_of(name: str, c: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those from 255 on stand beside, by place."""
    big = np.flatnonzero(c >= 255)
    return {f"{name}_count": np.minimum(c, 255).astype("u1"), f"{name}_big": big.astype("<u8"), f"{name}_value": c[big].astype("<u8")}


def _count_at(found: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    c = found[f"{name}_count"][at].astype(np.int64)
    big = np.flatnonzero(c == 255)
    if len(big):
        c[big] = found[f"{name}_value"][np.searchsorted(found[f"{name}_big"], at[big].astype(np.uint64))]
    return c


def _find(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in its own ascending stretch values[low:high], or -1.

    Stretches of like length are halved together, all at once.
    """
    low, high = low.astype(np.int64), high.astype(np.int64)
    size, out = high - low, np.full(len(low), -1, np.int64)
    least = 0
    for most in (1, 16, 1024, 1 << 62):
        rows = np.flatnonzero((size > least) & (size <= most))
        least = most
        if not len(rows):
            continue
        at, left, goal = low[rows], size[rows], wanted[rows]
        while int(left.max()) > 1:
            half = left >> 1
            at += half * (values[at + half - 1] < goal)
            left -= half
        at += values[at] < goal
        hit = at < high[rows]
        hit[hit] = values[at[hit]] == goal[hit]
        out[rows[hit]] = at[hit]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, by hashing first: only distinct keys are sorted."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


def word_ids(uri: str, bits: int, first_id: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of distinct ascending hashes."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    shard = (hashes >> _U(64 - bits)).astype(np.int64)
    cuts = _cuts(shard)
    for i, j in zip(cuts, cuts[1:], strict=False):
        s = int(shard[i])
        if first_id[s] == first_id[s + 1]:
            continue
        v = Arrays.of(uri).get(f"words-{s}")
        at = np.minimum(np.searchsorted(v["hash"], hashes[i:j]), len(v["hash"]) - 1)
        hit = v["hash"][at] == hashes[i:j]
        ids[i:j][hit] = first_id[s] + at[hit]
        counts[i:j][hit] = v["count"][at[hit]]
    return ids, counts


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
            h *= _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(32)
    return h


def _is_in(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[at] == ids


def trigram_shard(u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the middle word; a hot one's by (u, v), the start's (hot[-1]) by (v, w)."""
    other = np.where(v == hot[-1], w, u)
    h = np.where(_is_in(hot, v), _hash(v, other), _hash(v))
    return (h % _U(shards)).astype(np.int64)


def bigram_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (_hash(v, w) % _U(shards)).astype(np.int64)


def _counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray | None = None):
    """Distinct (v, u, w), ascending in that order, with their counts or summed counts."""
    (dv, iv), (du, iu), (dw, iw) = (np.unique(x, return_inverse=True) for x in (v, u, w))
    bu, bw = (max(1, len(d) - 1).bit_length() for d in (du, dw))
    if bu + bw + max(1, len(dv) - 1).bit_length() <= 64:
        keys = (iv.astype(np.uint64) << _U(bu + bw)) | (iu.astype(np.uint64) << _U(bw)) | iw.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
    else:
        order = np.lexsort((iw, iu, iv))
        iv, iu, iw = iv[order], iu[order], iw[order]
        new = np.append(True, (iv[1:] != iv[:-1]) | (iu[1:] != iu[:-1]) | (iw[1:] != iw[:-1]))
    head = np.flatnonzero(new)
    first = order[head]
    total = np.diff(np.append(head, len(order))) if c is None else np.add.reduceat(c[order], head)
    return u[first], v[first], w[first], total


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts 1 to 4; 0.5, 0.75 and 0.9 where one is missing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 0.9
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, d1), (2, d2), (3, d3)))


def _discount(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _sums(context_ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per run of equal contexts: (ids, [total, how many 1, 2, and 3 or more])."""
    head = np.flatnonzero(np.append(True, context_ids[1:] != context_ids[:-1])) if len(context_ids) else np.zeros(0, np.int64)
    fields = (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64))
    return context_ids[head], [np.add.reduceat(x, head) if len(head) else x for x in fields]


# Rows that the counting steps leave: parts of bigrams, contexts' sums, continuations of
# words, and counts of counts of orders 3 and 2.
_BIGRAMS, _CONTEXTS, _FOLLOWED, _ORDER3, _ORDER2 = range(5)
_STATS = "kind int, shard int, ids binary, f0 binary, f1 binary, f2 binary, f3 binary, c1 long, c2 long, c3 long, c4 long"


def _row(kind: int, shard: int, arrays=(), counts=(0, 0, 0, 0)) -> tuple:
    cells = [_squeeze(np.asarray(a).astype("<u8")) for a in arrays]
    return (kind, shard, *cells, *[b""] * (5 - len(cells)), *counts)


def _stats_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _STATS.split(", ")])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of ``docs`` (null text: empty) and leave the arrays in the shared folder."""
    spark = docs.sparkSession
    uri = scratch(spark, "ngrams")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, chars / RANGE)))))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = _cuts((h >> _U(64 - bits)).astype(np.int64))
            parts = list(zip(cuts, cuts[1:], strict=False))
            return _rows(
                ["shard", "keys", "counts"], [int(h[i] >> _U(64 - bits)) for i, _ in parts],
                [h[i:j].tobytes() for i, j in parts], [_squeeze(c[i:j].astype("<u8")) for i, j in parts],
            )

        for batch in small_batches(batches):
            held.append(_sequences(batch.column(0))[0])
            if sum(map(len, held)) >= RUN:
                yield block()
        if held:
            yield block()

    def merge_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = _grouped(
            np.concatenate([np.frombuffer(x, "<u8") for x in pdf["keys"]]), np.concatenate([_expand(x) for x in pdf["counts"]]).astype(np.int64)
        )
        _save(uri, f"words-{key[0]}", hash=h, count=c)
        return pd.DataFrame({"shard": [key[0]], "types": [len(h)], "tokens": [int(c.sum())]})

    blocks = texts.mapInArrow(count_words, "shard int, keys binary, counts binary")
    ranges = written(blocks.groupBy("shard").applyInPandas(merge_words, "shard int, types long, tokens long"), "words")
    types, tokens = np.zeros(1 << bits, np.int64), 0
    for r in ranges.collect():  # one row for each RANGE characters
        types[r["shard"]] = r["types"]
        tokens += r["tokens"]
    first_id = np.append(0, np.cumsum(types))
    V = int(first_id[-1])
    start, none = V, V + 1
    idt = "<u4" if V + 2 < 1 << 32 else "<u8"
    shards = max(LEAST_SHARDS, -(-tokens // SHARD))
    floor = max(64, tokens // shards)  # fewer than ``shards`` words can be above it

    def hot_words(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [first_id[s] + np.flatnonzero(Arrays.of(uri).get(f"words-{s}")["count"] > floor) for s in pdf["shard"]]
        return pd.DataFrame({"id": np.concatenate(out) if out else np.zeros(0, np.int64)})

    found = ranges.select("shard").mapInPandas(lambda it: map(hot_words, it), "id long").collect()
    hot = np.array(sorted(r[0] for r in found) + [start], np.int64)
    discard(ranges)

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def blocks():
            every = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for low in range(0, len(every[0]), RUN):  # one text may be longer than a run
                u, v, w, c = _counted(*(x[low : low + RUN] for x in every))
                shard = trigram_shard(u, v, w, hot, shards)
                order = np.argsort(shard, kind="stable")
                shard, u, v, w, c = (x[order] for x in (shard, u, v, w, c))
                cuts = _cuts(shard)
                parts = list(zip(cuts, cuts[1:], strict=False))
                yield _rows(
                    ["shard", "v", "u", "w", "counts"], [int(shard[i]) for i, _ in parts],
                    [_squeeze(np.diff(v[i:j], prepend=0).astype("<u8")) for i, j in parts],
                    *([_squeeze(x[i:j].astype("<u8")) for i, j in parts] for x in (u, w, c)),
                )

        for batch in small_batches(batches):
            h, at = _sequences(batch.column(0))
            distinct, back = _distinct(h)
            w = word_ids(uri, bits, first_id, distinct)[0][back]
            v = np.append(start, w[:-1])
            v[at[:-1]] = start
            u = np.append(none, v[:-1])
            u[at[:-1]] = none
            held.append((u, v, w))
            if sum(len(x[0]) for x in held) >= RUN:
                yield from blocks()
        if held:
            yield from blocks()

    def lexicon_rows(contexts, sums, words, follows) -> list[tuple]:
        rows = []
        for kind, ids, fields in ((_CONTEXTS, contexts, sums), (_FOLLOWED, words, [follows])):
            shard = np.where(ids == start, 1 << bits, np.searchsorted(first_id, ids, side="right") - 1)
            cuts = _cuts(shard)
            rows += [_row(kind, int(shard[i]), [ids[i:j], *(f[i:j] for f in fields)]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return rows

    def bigram_rows(order: np.ndarray, v, w, a) -> list[tuple]:
        """What finished bigrams, ascending by (v, w), leave for the lexicon."""
        contexts, sums = _sums(v, a)
        words, follows = np.unique(w, return_counts=True)
        counts = tuple(int((a == k).sum()) for k in (1, 2, 3, 4))
        return [_row(order, -1, counts=counts), *lexicon_rows(contexts, sums, words, follows)]

    def merge_trigrams(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.cumsum(_expand(x).astype(np.int64)) for x in pdf["v"]])
        u, w, c = (np.concatenate([_expand(x).astype(np.int64) for x in pdf[f]]) for f in ("u", "w", "counts"))
        u, v, w, c = _counted(u, v, w, c)
        first = v == start  # the text's first words: bigrams with their counts
        parts = [(v[first], w[first], c[first])]
        u, v, w, c = u[~first], v[~first], w[~first], c[~first]
        rows = [_row(_ORDER3, -1, counts=tuple(int((c == k).sum()) for k in (1, 2, 3, 4)))]
        # Adjusted counts: how many different u come before (v, w).
        _, bv, bw, a = _counted(np.zeros(len(v), np.int64), v, w) if len(v) else (u, v, w, c)
        split = _is_in(hot, bv)
        parts.append((bv[split], bw[split], a[split]))
        bv, bw, a = bv[~split], bw[~split], a[~split]
        rows += bigram_rows(_ORDER2, bv, bw, a)
        v_part, w_part, a_part = (np.concatenate(x) for x in zip(*parts, strict=True))
        shard = bigram_shard(v_part, w_part, shards)
        order = np.argsort(shard, kind="stable")
        shard, v_part, w_part, a_part = (x[order] for x in (shard, v_part, w_part, a_part))
        cuts = _cuts(shard)
        rows += [_row(_BIGRAMS, int(shard[i]), [v_part[i:j], w_part[i:j], a_part[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        new = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])) if len(v) else np.zeros(0, bool)
        head = np.flatnonzero(new)  # contexts
        middle, at = np.unique(v[head], return_index=True)
        size = np.diff(np.append(head, len(v)))
        heavy = np.flatnonzero(size >= HEAVY)
        context = np.cumsum(new) - 1
        ids, sums = _sums(context[size[context] >= HEAVY], c[size[context] >= HEAVY]) if len(heavy) else (heavy, [heavy] * 4)
        low = np.searchsorted(bv, middle)
        wide = "<u4" if len(v) < 1 << 32 else "<u8"
        _save(
            uri, f"trigrams-{key[0]}", v=middle.astype(idt), contexts=np.append(at, len(head)).astype(wide),
            u=u[head].astype(idt), words=np.append(head, len(v)).astype(wide), w=w.astype(idt), **_counts_of("c", c),
            heavy=ids.astype(wide), heavy_total=sums[0].astype("<u8"), heavy_1=sums[1].astype(idt), heavy_2=sums[2].astype(idt),
            bigrams=np.append(low, len(bv)).astype(wide), b=bw.astype(idt), **_counts_of("a", a),
        )
        return _stats_frame(rows)

    blocks = texts.mapInArrow(count_trigrams, "shard int, v binary, u binary, w binary, counts binary")
    stats = written(blocks.groupBy("shard").applyInPandas(merge_trigrams, _STATS), "trigrams")

    def merge_bigrams(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v, w, a = (np.concatenate([_expand(x).astype(np.int64) for x in pdf[f]]) for f in ("ids", "f0", "f1"))
        _, v, w, a = _counted(np.zeros(len(v), np.int64), v, w, a)
        middle, at = np.unique(v, return_index=True)
        _save(uri, f"bigrams-{key[0]}", v=middle.astype(idt), bigrams=np.append(at, len(v)).astype("<u8"), b=w.astype(idt), **_counts_of("a", a))
        return _stats_frame(bigram_rows(_ORDER2, v, w, a))

    whole = written(stats.where(f"kind = {_BIGRAMS}").groupBy("shard").applyInPandas(merge_bigrams, _STATS), "bigrams")
    stats = stats.where(f"kind <> {_BIGRAMS}").union(whole)

    def merge_lexicon(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        base, size = (start, 1) if s == 1 << bits else (int(first_id[s]), int(types[s]))
        fields = [np.zeros(size, np.int64) for _ in range(4)]
        followed = np.zeros(size, np.int64)
        for kind, ids, *cells in pdf[["kind", "ids", "f0", "f1", "f2", "f3"]].itertuples(index=False):
            at = _expand(ids).astype(np.int64) - base
            for array, cell in zip(fields if kind == _CONTEXTS else [followed], cells, strict=False):
                array[at] += _expand(cell).astype(np.int64)
        _save(uri, f"lexicon-{s}", total=fields[0], followed=followed, **{f"n{k}": fields[k].astype(idt) for k in (1, 2, 3)})
        row = [int(followed.sum()), *(int((followed == k).sum()) for k in (1, 2, 3, 4)), int((followed >= 3).sum())]
        return pd.DataFrame([row], columns=["sum", "c1", "c2", "c3", "c4", "c3p"])

    parts = stats.where(F.col("kind").isin(_CONTEXTS, _FOLLOWED))
    low = written(parts.groupBy("shard").applyInPandas(merge_lexicon, "sum long, c1 long, c2 long, c3 long, c4 long, c3p long"), "lexicon")
    sums = lambda df, *names: [int(x or 0) for x in df.agg(*(F.sum(c) for c in names)).first()]
    of_order = lambda kind: _discounts(sums(stats.where(f"kind = {kind}"), "c1", "c2", "c3", "c4"))
    everything, c1, c2, c3, c4, c3p = sums(low, "sum", "c1", "c2", "c3", "c4", "c3p")
    d = _discounts([c1, c2, c3, c4])
    mass = (d[0] * c1 + d[1] * c2 + d[2] * c3p) / everything if everything else 1.0
    return Model(uri, bits, first_id, tokens, shards, hot, (d, of_order(_ORDER2), of_order(_ORDER3)), mass, everything)


def _lexicon(m: Model, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of distinct ascending ids (all known, or V for the start)."""
    out = {f: np.zeros(len(ids), np.int64) for f in ("total", "followed", "n1", "n2", "n3")}
    shard = np.where(ids == m.types, 1 << m.bits, np.searchsorted(m.first_id, ids, side="right") - 1)
    cuts = _cuts(shard)
    for i, j in zip(cuts, cuts[1:], strict=False):
        s = int(shard[i])
        found = Arrays.of(m.uri).get(f"lexicon-{s}")
        at = ids[i:j] - (m.types if s == 1 << m.bits else m.first_id[s])
        for f in out:
            out[f][i:j] = found[f][at]
    return out


def _by_file(file: np.ndarray):
    """(file number, its rows) of every file that rows belong to."""
    order = np.argsort(file, kind="stable")
    cuts = _cuts(file[order])
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(file[order[i]]), order[i:j]


def _bigram_counts(m: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Adjusted counts of distinct (v, w), 0 where there is none."""
    split = _is_in(m.hot, v)
    file = np.where(split, m.shards + bigram_shard(v, w, m.shards), trigram_shard(v, v, w, m.hot[-1:], m.shards))
    out = np.zeros(len(v), np.int64)
    for f, rows in _by_file(file):
        found = Arrays.of(m.uri).find(f"bigrams-{f - m.shards}" if f >= m.shards else f"trigrams-{f}")
        if found is None or not len(found["v"]):
            continue
        at = np.minimum(np.searchsorted(found["v"], v[rows]), len(found["v"]) - 1)
        hit = found["v"][at] == v[rows]
        rows, at = rows[hit], at[hit]
        place = _find(found["b"], found["bigrams"][at], found["bigrams"][at + 1], w[rows])
        out[rows[place >= 0]] = _count_at(found, "a", place[place >= 0])
    return out


def _trigram_counts(m: Model, u: np.ndarray, v: np.ndarray, context: np.ndarray, w: np.ndarray):
    """(count of each (context, w), total and counts of counts of each context (u, v)).

    ``context`` indexes the distinct contexts, ascending.
    """
    c, total, n = np.zeros(len(w), np.int64), np.zeros(len(u), np.int64), np.zeros((3, len(u)), np.int64)
    file = trigram_shard(u, v, v, m.hot, m.shards)
    first = np.searchsorted(context, np.arange(len(u) + 1))
    for f, rows in _by_file(file):
        found = Arrays.of(m.uri).find(f"trigrams-{f}")
        if found is None or not len(found["v"]):
            continue
        at = np.minimum(np.searchsorted(found["v"], v[rows]), len(found["v"]) - 1)
        hit = found["v"][at] == v[rows]
        rows, at = rows[hit], at[hit]
        place = _find(found["u"], found["contexts"][at], found["contexts"][at + 1], u[rows])
        rows, place = rows[place >= 0], place[place >= 0]
        if not len(rows):
            continue
        low, high = found["words"][place].astype(np.int64), found["words"][place + 1].astype(np.int64)
        size = high - low
        many = size >= HEAVY
        k = np.searchsorted(found["heavy"], place[many])
        total[rows[many]] = found["heavy_total"][k]
        n[0, rows[many]], n[1, rows[many]] = found["heavy_1"][k], found["heavy_2"][k]
        few, length = np.flatnonzero(~many), size[~many]
        if len(few):
            head = np.cumsum(length) - length
            each = _count_at(found, "c", np.repeat(low[few] - head, length) + np.arange(length.sum()))
            total[rows[few]] = np.add.reduceat(each, head)
            n[0, rows[few]], n[1, rows[few]] = np.add.reduceat(each == 1, head, dtype=np.int64), np.add.reduceat(each == 2, head, dtype=np.int64)
        n[2, rows] = size - n[0, rows] - n[1, rows]
        asked = first[rows + 1] - first[rows]
        items = np.repeat(first[rows] - np.cumsum(asked) + asked, asked) + np.arange(asked.sum())
        where = _find(found["w"], np.repeat(low, asked), np.repeat(high, asked), w[items])
        c[items[where >= 0]] = _count_at(found, "c", where[where >= 0])
    return c, total, n


def score_batch(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_tokens, n_known, base_score, score) of each text."""
    h, at = _sequences(column)
    distinct, w = _distinct(h)
    ids, counts = word_ids(m.uri, m.bits, m.first_id, distinct)
    V, n = m.types, len(ids)
    base = np.log10((counts + 1) / (m.tokens + V + 1))
    # Words by their place among the batch's own; n is the start, n + 1 what is before it.
    every = np.append(ids, [V, V + 1])
    v = np.append(n, w[:-1])
    v[at[:-1]] = n
    u = np.append(n + 1, v[:-1])
    u[at[:-1]] = n + 1
    pairs, in_pairs = _distinct(v * (n + 2) + w)
    pv, pw = pairs // (n + 2), pairs % (n + 2)
    lower = np.full(n + 2, (m.mass if m.tokens else 1.0) / (V + 1))
    p = lower[pw]
    if m.tokens:
        known = np.append(np.flatnonzero(ids >= 0), n)
        known = known[np.argsort(every[known])]
        lexicon = {f: np.zeros(n + 2, np.int64) for f in ("total", "followed", "n1", "n2", "n3")}
        for f, x in _lexicon(m, every[known]).items():
            lexicon[f][known] = x
        d1, d2, d3 = m.discounts
        a = lexicon["followed"]
        lower += (a - _discount(d1, a)) / max(1, m.continuations)
        p = lower[pw]
        total = lexicon["total"][pv]
        seen = np.flatnonzero(total > 0)
        gamma = sum(d * lexicon[f][pv[seen]] for d, f in zip(d2, ("n1", "n2", "n3"), strict=True)) / total[seen]
        p[seen] *= gamma
        both = seen[ids[pw[seen]] >= 0]
        a = _bigram_counts(m, every[pv[both]], every[pw[both]])
        p[both] += (a - _discount(d2, a)) / total[both]
        # Trigrams: distinct contexts (u, v), and in each its distinct words.
        inner = np.flatnonzero((v != n) & (every[v] >= 0) & (every[u] >= 0))
        contexts, in_contexts = _distinct(u[inner] * (n + 2) + v[inner])
        items, in_items = _distinct(in_contexts * (n + 2) + w[inner])
        q = p[in_pairs]
        if len(inner):
            context, word = items // (n + 2), every[items % (n + 2)]
            c, total, kinds = _trigram_counts(m, every[contexts // (n + 2)], every[contexts % (n + 2)], context, word)
            gamma = (np.array(d3) @ kinds) / np.maximum(total, 1)
            share = (c - _discount(d3, c)) / np.maximum(total, 1)[context]
            known = total[context] > 0
            q[inner] = np.where(known[in_items], share[in_items] + gamma[context][in_items] * q[inner], q[inner])
    else:
        q = p[in_pairs]
    sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
    return np.diff(at), sums((counts[w] > 0).astype(np.int64)), sums(base[w]), sums(np.log10(q))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, known, base, full = score_batch(model, batch.column(1))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows whose id's text has crc32 mod 7 other than 2; score every row.

    Null text is empty: one token, its end.  A null id counts as empty text.  Repeated rows
    count each.  With no training rows the model is uniform over the unknown word.  An
    empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(~held_out(id_col)), text_col)
    out = score(docs, model, id_col, text_col)
    return out.withColumn("held_out", held_out("id")).withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out_scores(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )
