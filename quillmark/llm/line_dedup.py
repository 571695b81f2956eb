"""Fuzzy line deduplication: MinHash candidates, exact Jaccard, distributed union-find.

Method
------
1. Each non-blank line is squeezed and lower-cased; equal ones share a 64-bit line id
   (among n different lines about n^2 / 2^65 pairs share one by chance).
2. Signatures of its character shingles are cut into bands; lines that share a band are
   candidates.  Bands draw their rows from the bins, each bin in one or two of them; a pair
   at the threshold shares a band with probability 0.996.  Bins that no shingle hits are filled by further hash rounds over the same
   shingles, so short lines have a full signature too.
3. A task sorts the bands of its different lines and sends them as delta-coded blocks to
   shards of the band hash.  A band that very many lines of one task hold goes to shards
   of band and line instead, and two witnesses keep its other members from being taken
   for single.  Shards give the buckets of two or more lines; equal buckets count once.
4. A bucket of up to SMALL lines tests its pairs at once.  Larger ones go in pieces of
   PIECE lines beside some hubs a round, and on only while their lines still lie in
   different components, so n near copies cost about HUBS * n tests.  Hubs grow by MORE
   from round to round, so there are few rounds.  No bucket is cut short.
5. A test first compares sketches, two bits of each minimum: a pair at the threshold has
   0.85 of its fields equal, and one with fewer than SKETCH of them (4.5 deviations less,
   three in a million) goes no further.  For the others the lines' texts travel, and the
   exact Jaccard similarity of their shingle sets decides.
6. Components by distributed union-find; of each the first line by (document, line) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import connected_components
from .shared import discard, free_name, table, weighted_join, written
from .textkernel import small_batches

#: At width 5 a line of 54 characters stays over the threshold when a short word is put in.
SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS, BINS = 6, 20, 96
#: Bins of each band: all of them in turn, then again in another order.
_BAND_BINS = np.concatenate([np.arange(BINS), np.arange(BINS) * 37 % BINS])[: ROWS * BANDS].reshape(BANDS, ROWS)
#: Buckets of so many lines compare all pairs at once; larger ones take about HUBS hubs in the
#: first round, when all lines are apart, and MORE times as many in each further one.
SMALL, HUBS, MORE = 64, 2, 16
#: Lines of a large bucket, and hubs of the round, that are tested in one piece of work.
PIECE = 512
#: Share of equal two-bit fields below which a pair's texts are not compared.
SKETCH = 0.686
#: Characters aimed at per shard of the bands, lines a task gathers before it sends blocks,
#: and how many of them may share a band before it is dealt by line.
SHARD, RUN, HOT = 16 << 20, 50_000, 256
#: Line ids a task remembers so as not to emit a line's bands and text again.
REMEMBERED = 500_000
#: Bits of the largest bitmap of needed line ids that is sent to the workers (16 MB).
BITMAP_BITS = 27
#: Lines of more characters are compared as sorted hash arrays, not as sets of strings.
LONG = 20_000
#: Shingles hashed at a time, and characters of lines that are spelt at a time.
WINDOW, SPELT = 1 << 14, 1 << 18
#: Rounds of hashes that fill a signature's empty bins before they are filled one by one.
TURNS = 32

_P = np.uint64(0x9E3779B97F4A7C15)
_U, _S = np.uint64, np.uint32
_EMPTY = np.uint32(0xFFFFFFFF)
_BUCKET_BITS = 48
#: Different letters of a group of lines, below which a shingle of five is a number of 60 bits.
_LETTERS = np.uint64(1 << 12)


def squeezed(line: str) -> str:
    low = line.lower()
    # All white space but the space itself counts as not printable.
    return low.strip(" ") if low.isprintable() and "  " not in low else " ".join(low.split())


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _stir(h: np.ndarray) -> np.ndarray:
    h ^= h >> _S(16)
    h *= _S(0x7FEB352D)
    h ^= h >> _S(15)
    h *= _S(0x846CA68B)
    h ^= h >> _S(16)
    return h


#: Odd factor of each row of each band, so that a band is hashed by one sum.
_FACTORS = _mix((np.arange(BANDS * ROWS, dtype=np.uint64) + _U(1)) * _P).reshape(BANDS, ROWS) | _U(1)


def line_ids(lines: list[str]) -> np.ndarray:
    """XXH64 of each line as a signed long; lines differ in length, so one call each."""
    found = [xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines]
    return np.array(found, np.uint64).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rolled(code: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE codes."""
    return _mix(_spelt(code, _P))


def _spelt(code: np.ndarray, base: np.unsignedinteger) -> np.ndarray:
    """All runs of SHINGLE codes as numbers of ``base``, modulo 2^64 or 2^32 as its type is; of two halves of twos each."""
    kind = type(base)
    c, n = code.astype(kind, copy=False), len(code) - SHINGLE + 1
    two = c[:-1] * base + c[1:]
    out = (two[:-2] * kind(int(base) ** 2 & int(np.iinfo(kind).max)) + two[2:])[:n]
    out *= base
    out += c[SHINGLE - 1 :]
    return out


def shingle_hashes(line: str) -> np.ndarray:
    """Distinct 64-bit hashes of a line's shingles, ascending."""
    code = _codes(line.ljust(SHINGLE, "\x00"))
    return np.unique(np.concatenate([_rolled(code[p : p + WINDOW + SHINGLE - 1]) for p in range(0, len(code) - SHINGLE + 1, WINDOW)]))


def _least(h: np.ndarray, size: np.ndarray, turn: int) -> np.ndarray:
    """(lines, BINS) minima of the round's hashes; ``size`` says how many of ``h`` each line has."""
    out = np.full((len(size), BINS), _EMPTY, np.uint32)
    flat, first = out.ravel(), np.repeat(np.arange(len(size)) * BINS, size)
    for p in range(0, len(h), WINDOW):
        x = h[p : p + WINDOW]
        if turn:
            x = np.minimum(_stir(x + _S(turn * int(_P) & 0xFFFFFFFF)), _EMPTY - _S(1))
        at = x >> _S(8)  # an equal share of the numbers to each bin
        at *= _S(BINS)
        at >>= _S(24)
        np.minimum.at(flat, first[p : p + WINDOW] + at, x)
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) minima: a shingle goes to one bin by its hash of 32 bits; what stays empty is
    filled by up to TURNS further rounds with other hashes of the same shingles, then bin by bin."""
    padded = [x.ljust(SHINGLE, "\x00") for x in lines]
    size = np.array([len(x) for x in padded], np.int64)
    code, ends = _codes("".join(padded)), np.cumsum(size)
    h = np.full(len(code), _EMPTY, np.uint32)
    inside = np.ones(len(code), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    with np.errstate(over="ignore"):
        for p in range(0, len(code) - SHINGLE + 1, WINDOW):
            x = _stir(_spelt(code[p : p + WINDOW + SHINGLE - 1], _S(int(_P) >> 32 | 1)))
            h[p : p + len(x)] = np.minimum(x, _EMPTY - _S(1))
        h[~inside] = _EMPTY  # no bin takes it
        full = _least(h, size, 0)
        left = np.arange(len(lines))
        for turn in range(1, TURNS + 1):
            lacking = (full[left] == _EMPTY).any(1)
            if not lacking.any():
                break
            pick = np.repeat(lacking, size)
            if turn == 1:
                pick &= inside
                size = size - SHINGLE + 1
            h, left, size = h[pick], left[lacking], size[lacking]
            held = full[left]
            full[left] = np.where(held == _EMPTY, _least(h, size, turn), held)
        for k in np.flatnonzero((full == _EMPTY).any(1)).tolist():
            x = shingle_hashes(lines[k])
            for b in np.flatnonzero(full[k] == _EMPTY).tolist():
                full[k, b] = min(int(_mix(x + _U(TURNS + b + 1) * _P).min()) & 0xFFFFFFFF, 0xFFFFFFFE)
    return full


def sketches(lines: list[str]) -> np.ndarray:
    """(lines, 3) words of 64 bits: the two lowest bits of each bin's mixed minimum."""
    with np.errstate(over="ignore"):
        two = (_stir(signatures(lines).T + _S(int(_P) >> 32)) & _S(3)).astype(np.uint64)
    out = np.zeros((3, len(lines)), np.uint64)
    for b in range(BINS):
        out[b // 32] |= two[b] << _U(2 * (b % 32))
    return np.ascontiguousarray(out.T)


def _alike_fields(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the BINS fields of each pair of sketches are equal."""
    d = x ^ y
    return BINS - np.bitwise_count((d | (d >> _U(1))) & _U(0x5555555555555555)).sum(1)


def band_hashes(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) hashes of the signature's bands as signed longs; no line may be empty."""
    sign = np.ascontiguousarray(signatures(lines).T).astype(np.uint64)
    out = np.empty((len(lines), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(lines), _FACTORS[b, 0] * _U(b + 1), np.uint64)
            for k, factor in zip(_BAND_BINS[b].tolist(), _FACTORS[b], strict=True):
                x += sign[k] * factor
            out[:, b] = _mix(x)
    return out.view(np.int64)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _lines(text: str | None) -> list[tuple[int, str]]:
    found = ((k, squeezed(x)) for k, x in enumerate((text or "").split("\n")))
    return [(k, s) for k, s in found if s]


class _Seen(set):
    """Line ids that a task has met; from REMEMBERED on it learns no more, so ids come again."""

    def new(self, ids: np.ndarray) -> np.ndarray:
        _, first = np.unique(ids, return_index=True)
        fresh = [k for k in first.tolist() if int(ids[k]) not in self]
        if len(self) < REMEMBERED:
            self.update(ids[fresh].tolist())
        return np.array(fresh, np.int64)


# Buckets ------------------------------------------------------------------------------


def _planes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block_rows(bucket: np.ndarray, lid: np.ndarray, shards: int) -> pa.RecordBatch:
    """Blocks of one run: (shard, hot, buckets as sorted deltas, lids)."""
    order = np.argsort(bucket)
    bucket, lid = bucket[order], lid[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    count = np.diff(np.append(head, len(bucket)))
    much = np.repeat(count > HOT, count)
    place = ((bucket >> _U(_BUCKET_BITS - 32)) * _U(shards) >> _U(32)).astype(np.int64)
    parts = [(0, place[~much], bucket[~much], lid[~much])]
    if much.any():
        # Two witnesses of a crowded band go to its own shard, its lines to shards of their own.
        witness = np.concatenate([head[count > HOT], head[count > HOT] + 1])
        witness.sort()
        parts.append((1, place[witness], bucket[witness], lid[witness]))
        b, x = bucket[much], lid[much]
        with np.errstate(over="ignore"):
            own = (_mix(b * _P + x) % _U(shards)).astype(np.int64)
        order = np.lexsort((b, own))
        parts.append((2, own[order], b[order], x[order]))
    rows: list[tuple[int, int, bytes, bytes]] = []
    for kind, shard, b, x in parts:
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = int(shard[i]) + (shards if kind == 2 else 0)
            rows.append((at, kind, _planes(np.diff(b[i:j], prepend=_U(0))), _planes(x[i:j])))
    shard, kind, buckets, lids = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(buckets, pa.binary()), pa.array(lids, pa.binary())],
        names=["shard", "kind", "buckets", "lids"],
    )


def _lists(keys: np.ndarray, lids: np.ndarray, cuts: np.ndarray, large: bool) -> pa.Table:
    heads = cuts[:-1]
    members = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(lids.view(np.int64)))
    return pa.table({"bucket": pa.array(keys[heads].view(np.int64)), "lids": members, "large": pa.array([large] * len(heads), pa.bool_())})


_NO_LISTS = pa.table({"bucket": pa.array([], pa.int64()), "lids": pa.array([], pa.list_(pa.int64())), "large": pa.array([], pa.bool_())})


def _merge_blocks(blocks: pa.Table) -> pa.Table:
    """Buckets of two or more lines of one shard: small ones whole, large ones in rows of 4,096."""
    bucket = np.concatenate([np.cumsum(_from_planes(x)) for x in blocks.column("buckets").to_pylist()])
    sizes = [len(x) // 8 for x in blocks.column("lids").to_pylist()]
    lid = np.concatenate([_from_planes(x) for x in blocks.column("lids").to_pylist()])
    kind = np.repeat(blocks.column("kind").to_numpy(), sizes)
    # Most bands are of one line: they go before lines are put in order.
    order = np.argsort(bucket)
    ranked = bucket[order]
    same = ranked[1:] == ranked[:-1]
    order = order[np.append(False, same) | np.append(same, False) | (kind[order] > 0)]
    if not len(order):
        return _NO_LISTS
    bucket, lid, kind = bucket[order], lid[order], kind[order]
    order = np.lexsort((lid, bucket))
    bucket, lid, kind = bucket[order], lid[order], kind[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (lid[1:] != lid[:-1]))
    group = np.cumsum(np.append(True, bucket[1:] != bucket[:-1])) - 1
    crowded = np.zeros(group[-1] + 1, bool)
    crowded[group[kind > 0]] = True
    bucket, lid, group = bucket[new], lid[new], group[new]
    count = np.bincount(group)
    large = crowded | (count > SMALL)
    out = []
    for which, pick in ((False, ~large & (count > 1)), (True, large)):
        keep = pick[group]
        b, x, c = bucket[keep], lid[keep], count[pick]
        if not len(b):
            continue
        cuts = np.append(0, np.cumsum(c))
        if which:  # a long list in pieces
            cuts = np.unique(np.concatenate([cuts, *(np.arange(i, j, 4096) for i, j in zip(cuts[:-1], cuts[1:], strict=True))]))
        out.append(_lists(b, x, cuts, which))
    return pa.concat_tables(out) if out else _NO_LISTS


def line_buckets(docs: DataFrame, text_col: str) -> DataFrame:
    """(bucket, lids, large): the bands that two or more different lines share."""
    size = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = -(-size // SHARD) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = _Seen(), []

        def send():
            bucket = np.concatenate([b for b, _ in held])
            lid = np.concatenate([x for _, x in held])
            held.clear()
            return _block_rows(bucket, lid, shards)

        for batch in small_batches(batches, 2 << 20):
            lines = [s for text in batch.column(0).to_pylist() for _, s in _lines(text)]
            if not lines:
                continue
            ids = line_ids(lines)
            fresh = seen.new(ids)
            for low in range(0, len(fresh), 4096):
                part = fresh[low : low + 4096]
                bands = band_hashes([lines[k] for k in part.tolist()]).view(np.uint64) >> _U(64 - _BUCKET_BITS)
                held.append((bands.ravel(), np.repeat(ids[part].view(np.uint64), BANDS)))
                if sum(len(x) for _, x in held) >= RUN * BANDS:
                    yield send()
        if held:
            yield send()

    blocks = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shard int, kind int, buckets binary, lids binary")
    return blocks.groupBy("shard").applyInArrow(_merge_blocks, "bucket long, lids array<long>, large boolean")


# Lines --------------------------------------------------------------------------------


class _Bitmap:
    """Which line ids are needed: one bit for each value of an id's leading bits.

    Its size is checked: beyond BITMAP_BITS there is none, every line counts as needed
    and the join by line id alone sorts them out.
    """

    def __init__(self, needed: DataFrame, count: int):
        self.bits = max(10, int(np.ceil(np.log2(max(1, count)))) + 4)
        self.shared = None
        if self.bits > BITMAP_BITS:
            return
        bits, pieces = self.bits, 16

        def fill(group: pa.Table) -> pa.Table:
            at = group.column("lid").to_numpy().view(np.uint64) >> _U(64 - bits)
            marks = np.zeros((1 << bits) // pieces, bool)
            marks[(at & _U(len(marks) - 1)).astype(np.int64)] = True
            return pa.table({"piece": [group.column("piece")[0].as_py()], "marks": [np.packbits(marks).tobytes()]}, schema=pa.schema([("piece", pa.int32()), ("marks", pa.binary())]))

        piece = F.shiftrightunsigned("lid", 60).cast("int").alias("piece")
        found = needed.select("lid", piece).groupBy("piece").applyInArrow(fill, "piece int, marks binary").collect()
        marks = np.zeros((pieces, (1 << bits) // pieces // 8), np.uint8)
        for r in found:
            marks[r["piece"]] = np.frombuffer(r["marks"], np.uint8)
        self.shared = needed.sparkSession.sparkContext.broadcast(marks.ravel())

    def holds(self, ids: np.ndarray) -> np.ndarray:
        if self.shared is None:
            return np.ones(len(ids), bool)
        at = ids.view(np.uint64) >> _U(64 - self.bits)
        return (self.shared.value[(at >> _U(3)).astype(np.int64)] >> (7 - (at & _U(7)).astype(np.uint8))) & 1 > 0


def occurrences(docs: DataFrame, id_col: str, text_col: str, needed: _Bitmap | None = None) -> DataFrame:
    """(id, line_no, lid, line, sketch) of every non-blank line; line and sketch are null but
    for the first of each needed line id that a task meets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in small_batches(batches, 2 << 20):
            row, number, lines = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                for k, s in _lines(text):
                    row.append(r)
                    number.append(k)
                    lines.append(s)
            if lines:
                ids = line_ids(lines)
                told, drawn = np.full(len(lines), None, object), np.full(len(lines), None, object)
                wanted = np.flatnonzero(needed.holds(ids)) if needed else np.zeros(0, np.int64)
                wanted = wanted[seen.new(ids[wanted])]
                for low in range(0, len(wanted), 4096):
                    part = wanted[low : low + 4096].tolist()
                    for k, words in zip(part, sketches([lines[k] for k in part]), strict=True):
                        told[k], drawn[k] = lines[k], words.tobytes()
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(ids), pa.array(told, pa.string()), pa.array(drawn, pa.binary())],
                    names=["id", "line_no", "lid", "line", "sketch"],
                )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, line_no int, lid long, line string, sketch binary")


class _Shingled:
    """A line's shingles: a sorted array of numbers, five ranks in ``alphabet`` each; without
    one a set of strings, for a long line a sorted array of hashes."""

    __slots__ = ("items", "line", "size")

    def __init__(self, line: str, alphabet: np.ndarray | None = None, items: np.ndarray | None = None):
        self.line = line
        if items is not None:
            self.items = items
        elif alphabet is None:
            self.items = shingles(line) if len(line) <= LONG else shingle_hashes(line)
        else:
            code = np.zeros(max(len(line), SHINGLE), np.int64)
            code[: len(line)] = np.searchsorted(alphabet, _codes(line)) + 1
            with np.errstate(over="ignore"):
                x = np.sort(_spelt(code, _LETTERS))
            self.items = x[np.append(True, x[1:] != x[:-1])]
        self.size = len(self.items)

    def alike(self, other: _Shingled) -> bool:
        small, big = (self, other) if self.size <= other.size else (other, self)
        if small.size < THRESHOLD * big.size:
            return False
        if isinstance(small.items, set) and isinstance(big.items, set):
            both = len(small.items & big.items)
        else:
            x, y = (s.items if isinstance(s.items, np.ndarray) else shingle_hashes(s.line) for s in (small, big))
            z = np.concatenate([x, y])
            z.sort()
            both = int(np.count_nonzero(z[1:] == z[:-1]))
        return both >= THRESHOLD * (self.size + other.size - both)


def _alphabet(lines: list[str]) -> np.ndarray | None:
    """The different codes of the lines, ascending, if a shingle of them is a number of 60 bits."""
    code = _codes("".join(lines))
    found = np.zeros(int(code.max(initial=0)) + 1, bool)
    found[code] = True
    found = np.flatnonzero(found)
    return found if len(found) < _LETTERS else None


def _all_shingled(lines: list[str], alphabet: np.ndarray | None) -> list[_Shingled]:
    """``_Shingled(line, alphabet)`` of each line, spelt together in runs of about SPELT characters."""
    if alphabet is None:
        return [_Shingled(x) for x in lines]
    rank = np.zeros(int(alphabet.max(initial=0)) + 1, np.uint64)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    made = [_Shingled(x, alphabet) if len(x) < SHINGLE else None for x in lines]
    rest = [k for k, x in enumerate(made) if x is None]
    total = np.cumsum([len(lines[k]) for k in rest])
    low = 0
    while low < len(rest):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + SPELT, side="right")))
        part = rest[low:high]
        with np.errstate(over="ignore"):
            x = _spelt(rank[_codes("".join([lines[k] for k in part]))], _LETTERS)
        ends = np.cumsum([len(lines[k]) for k in part])
        starts = np.append(0, ends[:-1])
        ends -= SHINGLE - 1
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            x[i:j].sort()
        new = np.append(True, x[1:] != x[:-1])
        new[starts] = True
        for k in range(SHINGLE - 1):  # shingles across two lines
            new[ends[:-1] + k] = False
        cuts = np.append(0, np.cumsum(np.add.reduceat(new, starts, dtype=np.int64))).tolist()
        x = x[new]
        for k, i, j in zip(part, cuts[:-1], cuts[1:], strict=True):
            made[k] = _Shingled(lines[k], items=x[i:j])
        low = high
    return made


_SCREENED = "piece long, lid long, root long, near array<long>"


def _pieces(batches: Iterator[pa.RecordBatch], bits: int = 0) -> Iterator[pa.Table]:
    """Tables that hold whole pieces, of batches sorted by piece; ``bits``: and all pieces that differ in so many low bits."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        piece = np.asarray(batch.column(0)) >> bits
        if not len(piece):
            continue
        cut = int(np.searchsorted(piece, piece[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif held and np.asarray(held[-1].column(0))[-1] >> bits != piece[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, lid, root, hub, sketch) sorted by piece -> (group, lid, root, near): rows that
    some pair keeps, with the others that they pair with.  Only pairs with a hub count.  Pieces
    with the same leading 32 bits are a group: a pair in several of them is told once."""
    for t in _pieces(batches, 32):
        piece, lid, root = (t.column(k).to_numpy() for k in (0, 1, 2))
        hub = t.column(3).to_numpy()
        words = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64).reshape(-1, 3)
        heads = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece))
        ends = np.repeat(heads[1:], np.diff(heads))
        left, right = [], []
        step, at = 1 << 20, 0
        after = ends - np.arange(len(piece)) - 1
        total = np.cumsum(after)
        while at < len(piece):  # so many pairs at a time
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
            n = after[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            good = (hub[i] | hub[j]) & (root[i] != root[j]) & (lid[i] != lid[j])
            i, j = i[good], j[good]
            good = _alike_fields(words[i], words[j]) >= SKETCH * BINS
            left.append(i[good])
            right.append(j[good])
            at = stop
        i, j = np.concatenate(left), np.concatenate(right)
        low, high = np.where(lid[i] < lid[j], i, j), np.where(lid[i] < lid[j], j, i)
        both = np.concatenate([low, high])
        group = piece[both] >> 32
        order = np.lexsort((lid[both], group))
        both, group = both[order], group[order]
        new = np.append(True, (group[1:] != group[:-1]) | (lid[both[1:]] != lid[both[:-1]]))[: len(both)]
        number = np.empty(len(both), np.int64)
        number[order] = np.cumsum(new) - 1
        rows, group = both[new], group[new]
        pairs = np.unique(number[: len(low)] * len(rows) + number[len(low) :])
        i, j = np.divmod(pairs, max(1, len(rows)))
        cuts = np.searchsorted(i, np.arange(len(rows) + 1))
        near = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(lid[rows[j]]))
        yield pa.record_batch([pa.array(group), pa.array(lid[rows]), pa.array(root[rows]), near], names=["piece", "lid", "root", "near"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, lid, root, near, line) sorted by piece -> links (a, b).

    Lines that are linked already, here or before, are not tested again.
    """
    for t in _pieces(batches):
        found: list[tuple[int, int]] = []
        piece = t.column(0).to_numpy()
        lid, root, near, line = (c.to_pylist() for c in t.columns[1:])
        total = np.cumsum([len(x) for x in line])
        heads = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece)).tolist()
        k = 0
        while k < len(heads) - 1:  # the pieces that begin within so many characters
            low, more = heads[k], k + 1
            while more < len(heads) - 1 and total[heads[more + 1] - 1] - total[low] < SPELT:
                more += 1
            own = slice(low, heads[more])
            alphabet = _alphabet(line[own])
            if alphabet is None and more > k + 1:  # too many letters: a piece may have fewer
                more, own = k + 1, slice(low, heads[k + 1])
                alphabet = _alphabet(line[own])
            sets = _all_shingled(line[own], alphabet)
            rows = list(zip(lid[own], root[own], near[own], sets, strict=True))
            for i, j in zip(heads[k:more], heads[k + 1 : more + 1], strict=True):
                found += _links_of(rows[i - low : j - low])
            k = more
        yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _links_of(rows: list) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    root = {lid: r for lid, r, _, _ in rows}
    sets = {lid: made for lid, _, _, made in rows}
    links = []
    for a, _, near, _ in rows:
        for b in near:
            x, y = top(root[a]), top(root[b])
            if x == y:
                continue
            if sets[a].alike(sets[b]):
                up[max(x, y)] = min(x, y)
                links.append((a, b))
    return links


def _links(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of pieces (piece, lid, root, hub): screened by sketches, verified by texts, a group in one task."""
    drawn = pieces.join(texts.select("lid", "sketch"), "lid").select("piece", "lid", "root", "hub", "sketch")
    screened = drawn.repartition(F.shiftright("piece", 32)).sortWithinPartitions("piece").mapInArrow(_screen, _SCREENED)
    screened = written(screened, "screened")
    rows = screened.join(texts.select("lid", "line"), "lid").select("piece", "lid", "root", "near", "line")
    out = written(rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(_verify, "a long, b long"), "links")
    discard(screened)
    return out


def _piece(first: Column, lids: Column) -> Column:
    """Hash of a small bucket; buckets with the same smallest line, BANDS at most, share the leading 32 bits."""
    return F.shiftleft(F.shiftright(F.xxhash64(first), 32), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(lids), 32))


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((node, root): line ids of every component of two or more different lines,
    (id, line_no, lid, line): all lines, a written table)."""
    found = written(line_buckets(docs, text_col), "buckets")
    sets = written(found.where("NOT large").select("lids").distinct().select(_piece(F.col("lids")[0], F.col("lids")).alias("piece"), "lids"), "sets")
    members = written(found.where("large").select("bucket", F.explode("lids").alias("lid")).distinct(), "members")
    discard(found)
    needed = written(sets.select(F.explode("lids").alias("lid")).union(members.select("lid")).distinct(), "needed")
    count = needed.count()
    occ = written(occurrences(docs, id_col, text_col, _Bitmap(needed, count)), "lines")
    texts = occ.where("line IS NOT NULL").select("lid", "line", "sketch").join(needed, "lid", "left_semi")
    texts = written(texts.groupBy("lid").agg(F.first("line").alias("line"), F.first("sketch").alias("sketch")), "texts")
    discard(needed)
    pieces = sets.select("piece", F.explode("lids").alias("lid")).withColumn("root", F.col("lid")).withColumn("hub", F.lit(True))
    labels, turn, similar = None, 0, None
    while True:
        many = None
        if not members.isEmpty():
            state = members.withColumn("root", F.col("lid"))
            if labels is not None:
                state = members.join(labels, F.col("lid") == F.col("node"), "left").select("bucket", "lid", F.coalesce("root", "lid").alias("root"))
            state = written(state, "state")
            # Of each bucket still in several components: its size and its largest component.
            parts = state.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.min("lid").alias("least")).groupBy("bucket")
            one = F.struct("least", "root")
            parts = parts.agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most"), F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("roots"))
            outside = F.when(F.col("low.root") != F.col("most.root"), F.col("low.least")).otherwise(F.col("high.least"))
            parts = parts.where("roots > 1").select("bucket", "n", (F.col("n") - F.col("most.c")).alias("k"), F.col("most.root").alias("main"), outside.alias("least"))
            parts = written(parts, "open")
            # The hubs are lines outside the bucket's largest component, whose own pairs need no
            # test: one such line that is always found, and those of the smallest hashes of the round.
            hubs = HUBS * MORE**turn
            drawn = F.pmod(F.xxhash64("lid", F.lit(turn)), F.lit(1 << 30)) * F.col("k") < F.lit(float(hubs << 30))
            hub = (F.col("root") != F.col("main")) & (drawn | (F.col("lid") == F.col("least")))
            many = written(weighted_join(state, parts, "bucket", "n", state.count()).select("bucket", "lid", "root", "n", "k", hub.alias("hub")), "many")
            # A grid of pieces: each share of the bucket's lines beside each share of its hubs.
            rows = F.ceil(F.col("n") / PIECE).cast("int")
            columns = F.ceil(F.least(F.col("k"), F.lit(hubs).cast("long")) / PIECE).cast("int")
            own, every = (lambda count: F.pmod(F.xxhash64("lid"), count).cast("int")), (lambda count: F.explode(F.sequence(F.lit(0), count - 1)))
            lines = many.withColumn("row", own(rows)).withColumn("column", every(columns)).withColumn("hub", F.lit(False))
            centres = many.where("hub").withColumn("column", own(columns)).withColumn("row", every(rows))
            large = lines.unionByName(centres.select(lines.columns)).select(F.xxhash64("bucket", "row", "column", F.lit(turn)).alias("piece"), "lid", "root", "hub")
            pieces = large if pieces is None else pieces.unionByName(large)
            discard(state, parts)
        if pieces is None:
            break
        edges = _links(pieces, texts)
        old = labels
        # What earlier rounds linked comes back as stars.
        labels = written(connected_components(edges if old is None else edges.union(old.select("node", "root"))), "labels")
        discard(old, edges)
        pieces, turn = None, turn + 1
        if many is None:
            break
        # Hubs have met all their bucket; the rest go on without them.
        old, members = members, written(many.where("NOT hub").select("bucket", "lid"), "members")
        discard(old, many)
    discard(sets, members, texts)
    return labels, occ


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, class_id, keep_id, keep_line, class_size, kept) of every non-blank line.

    Lines are split at ``\\n`` and numbered from 0; blank lines belong to no class and
    stay.  Null text has no lines.  Null ids count as the largest.  Rows that repeat an id
    count each, and the same line number of the same id stays or goes in all of them.
    Other columns are ignored; an empty table gives no rows.
    """
    labels, occ = line_components(docs, id_col, text_col)
    total = occ.count()
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("line_no"))
    # Equal lines first, then the lines of a component: all sums are partial.
    lids = occ.groupBy("lid").agg(F.min(place).alias("k"), F.count("*").alias("copies"))
    lids = lids.join(labels, F.col("lid") == F.col("node"), "left").select("lid", "k", "copies", F.coalesce("root", "lid").alias("class_id"))
    lids = written(lids, "lids")
    keep = lids.groupBy("class_id").agg(F.min("k").alias("k"), F.sum("copies").alias("class_size"), F.count("*").alias("different"))
    lids = weighted_join(lids.select("lid", "copies", "class_id"), keep, "class_id", "different", total)
    lids = written(lids.select("lid", "copies", "class_id", F.col("k.id").alias("keep_id"), F.col("k.line_no").alias("keep_line"), "class_size"), "classes")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("line_no") == F.col("keep_line"))
    out = weighted_join(occ.select("id", "line_no", "lid"), lids, "lid", "copies", total)
    return out.select("id", "line_no", "class_id", "keep_id", "keep_line", "class_size", kept.alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept; all columns stay, null text stays null."""
    lost = line_classes(docs, id_col, text_col).where(~F.col("kept"))
    of, gone = free_name(docs, "lost_id"), free_name(docs, "gone")
    lost = lost.groupBy("id").agg(F.collect_set("line_no").alias(gone)).withColumnRenamed("id", of)
    rows = docs.join(lost, docs[id_col].eqNullSafe(lost[of]), "left")
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    new = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_classes(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "line_no", F.col("keep_id").alias("keep_doc_id"), F.col("keep_line").alias("keep_line_no"), "class_size", "kept"
    )
