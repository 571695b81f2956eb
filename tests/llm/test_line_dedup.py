import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from quillmark.llm import line_dedup as L
from quillmark.llm.line_dedup import (
    _block_rows, _merge_blocks, _Shingled, band_hashes, jaccard, line_classes, line_dedup, shingles, signatures, squeezed,
)

SCHEMA = "doc_id long, text string, gone string, lid int"


def brute(rows):
    lines = sorted({squeezed(x) for _, t, *_ in rows for x in (t or "").split("\n")} - {""})
    root, sets = {x: x for x in lines}, {x: shingles(x) for x in lines}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if root[a] != root[b] and alike(a, b):
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        for k, x in enumerate((t or "").split("\n")):
            if squeezed(x):
                first.setdefault(root[squeezed(x)], (d, k))
    return {(d, k): first[root[squeezed(x)]] for d, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if squeezed(x)}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghié", k=rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(60)]
    rows = [(0, None, "x", 1), (1, "", "x", 1), (2, "\n \n\t", "x", 1), (3, "a\nA\n a ", "x", 1), (4, "z" * 60000, "x", 1)]
    hot = base[0].split()
    for i in range(5, 80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(base[1:]).split()
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = word()
            lines.append(" ".join(s).upper() if rng.random() < 0.2 else "  ".join(s))
        near = list(hot) * 8
        near[rng.randrange(len(near))] = word()  # over SMALL different near copies of one line
        lines.append(" ".join(near))
        rows.append((i, "\n".join(lines), "x", 1))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id"], r["line_no"]): (r["keep_id"], r["keep_line"]) for r in line_classes(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.995 * len(want)
    out = line_dedup(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] is None and texts[2] == "\n \n\t" and texts[3] == "a" and texts[4] == "z" * 60000
    kept = [squeezed(x) for t in texts.values() for x in (t or "").split("\n") if squeezed(x)]
    assert len(kept) == len(set(got.values()))


@pytest.mark.parametrize("length", [30, 50, 100, 200])
def test_recall_at_the_threshold(length):
    rng = random.Random(length)
    hits = total = tries = 0
    while total < 400 and tries < 200_000:
        tries += 1
        a = "".join(rng.choices("abcdefgh ", k=length))
        cut = rng.randrange(length)
        b = a[:cut] + "#" * rng.randint(0, 1 + length // 12) + a[cut + rng.randint(0, 1 + length // 12) :]
        if 0.8 <= jaccard(a, b) < 0.87:
            x = band_hashes([a, b])
            hits += bool(np.any(x[0] == x[1]))
            total += 1
    assert total == 400 and hits / total > 0.97


def test_long_lines_are_hashed_alike(monkeypatch):
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefgh ", k=30_000))
    b = a[:15_000] + "xyz" + a[15_000:]
    assert _Shingled(a).alike(_Shingled(b)) and not _Shingled(a).alike(_Shingled(a[:15_000]))
    whole = signatures([a, "x", b])
    monkeypatch.setattr(L, "WINDOW", 1000)
    assert np.array_equal(signatures([a, "x", b]), whole)


def test_crowded_bands_lose_no_line():
    rng = np.random.default_rng(5)
    lid = rng.integers(1, 1 << 62, 5000).astype(np.uint64)
    crowded = np.concatenate([np.full(1000, 77, np.uint64), rng.integers(0, 1 << 48, 4000).astype(np.uint64)])
    blocks = [pa.Table.from_batches([_block_rows(crowded, lid, 3)])]
    blocks.append(pa.Table.from_batches([_block_rows(np.array([77, 5, 9, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64), 3)]))
    rows = pa.concat_tables(blocks)
    found = {}
    for shard in set(rows.column("shard").to_pylist()):
        part = rows.filter(pa.compute.equal(rows.column("shard"), shard))
        for r in _merge_blocks(part).to_pylist():
            found.setdefault(r["bucket"], set()).update(x & 0xFFFFFFFFFFFFFFFF for x in r["lids"])
    assert found[77] == {int(x) for x in lid[:1000]} | {1}
    assert found[9] == {3, 4} and 5 not in found


def test_lines_beyond_the_bitmap_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "BITMAP_BITS", 3)
    rows = corpus()[:40]
    got = {(r["id"], r["line_no"]): (r["keep_id"], r["keep_line"]) for r in line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some line of text\nsome line of text", "a", 1, 2)], "doc_id long, text string, gone string, lost_id int, id int")
    out = line_dedup(df)
    assert out.columns == df.columns and out.first()["text"] == "some line of text"


def test_edges(spark):
    assert line_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert line_classes(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "one line\ntwo", "", 0), (7, "one line", "", 0), (7, "one line", "", 0)], SCHEMA)
    got = sorted((r["id"] or 0, r["line_no"], r["kept"], r["class_size"]) for r in line_classes(df).collect())
    assert got == [(0, 0, False, 3), (0, 1, True, 1), (7, 0, True, 3), (7, 0, True, 3)]


def test_short_lines_with_one_small_change_are_linked(spark):
    # Jaccard over 5-character shingles, on its own: 0.8 and more for each pair but the last.
    five = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    line = "ofshednd in thedntre nt, ouing the thanble shsh bleen."
    pairs = [
        (line, line.replace("nt, ouing", "nt, to ouing")),
        (line, line.replace("nt, ouing", "nt ouing")),
        ("the quick brown fox jumps over the lazy dog by the river", "the quick brown fox jumps over the lazy dog by the liver"),
        ("an entirely different sentence about bread and butter", "an entirely other phrase about cheese and some butter"),
    ]
    alike = [len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b)) for a, b in pairs]
    assert alike == [True, True, True, False]
    df = spark.createDataFrame([(k, "\n".join(p), "", 0) for k, p in enumerate(pairs)], SCHEMA)
    kept = {(r["id"], r["line_no"]): r["kept"] for r in line_classes(df).collect()}
    assert [kept[k, 1] for k in (1, 2, 3)] == [False, False, True]
    assert not kept[0, 1]


def test_shingles_as_numbers_are_those_of_strings():
    r = random.Random(3)
    lines = ["", "a", "ab", "ab\x00", "ab\x00\x00\x00", "abcde", "abcdef", "\U0001f600" * 9, "a" * 50]
    lines += ["".join(r.choices("ab\u2019\u00e9 ", k=r.randrange(1, 60))) for _ in range(60)]
    alphabet = np.unique(L._codes("".join(lines)))
    made = [L._Shingled(x, alphabet) for x in lines]
    for x, a in zip(lines, made):
        assert a.size == len(L.shingles(x))
        for y, b in zip(lines, made):
            assert a.alike(b) == (L.jaccard(x, y) >= L.THRESHOLD)


def test_a_pair_of_several_buckets_is_told_once():
    sketch = L.sketches(["one line of words"])[0].tobytes()
    rows = [(piece, lid, lid, True, sketch) for piece in ((5 << 32) + 1, (5 << 32) + 2, (6 << 32) + 1) for lid in (30, 10, 20)]
    names = ["piece", "lid", "root", "hub", "sketch"]
    batch = pa.record_batch([pa.array(list(c)) for c in zip(*rows)], names=names)
    for batches in ([batch], [batch.slice(k, 2) for k in range(0, 9, 2)]):
        got = [tuple(x.values()) for b in L._screen(iter(batches)) for x in b.to_pylist()]
        assert got == [(g, lid, lid, near) for g in (5, 6) for lid, near in ((10, [20, 30]), (20, [30]), (30, []))]


def test_squeezed_lines_are_those_of_split():
    odd = [c for c in map(chr, range(0x110000)) if c.isspace()]
    lines = ["", " ", "  ", "A  b", " A b ", "\u0130 \u03a3\u03a3 x", "a\u00adb", "\ud800 x", *odd]
    lines += [f"A{c}B" for c in odd] + [f"{c}A b" for c in odd] + [f"a B {c}" for c in odd]
    for x in lines:
        assert squeezed(x) == " ".join(x.lower().split())


def test_a_signature_is_of_the_set_of_shingles_alone():
    r = random.Random(11)
    lines = ["", "ab", "ab\x00", "aaaaa", "abcabcabcabcabc", "abcabcabc"]
    lines += ["".join(r.choices("abcdefgh \u2019", k=r.choice([4, 5, 6, 30, 100, 700, 3000]))) for _ in range(60)]
    whole = signatures(lines)
    assert whole.shape == (len(lines), L.BINS) and not (whole == L._EMPTY).any()
    for x, row in zip(lines, whole):
        assert np.array_equal(signatures([x])[0], row)
    assert np.array_equal(signatures(lines[::-1])[::-1], whole)
    assert np.array_equal(whole[4], whole[5]) and not np.array_equal(whole[1], whole[3])


def verified(lines):
    """Pairs of lines (by number) that ``_verify`` links: a piece for each two lines that follow each other."""
    rows = [(p, lid, lid, [p + 1] if lid == p else [], lines[lid]) for p in range(len(lines) - 1) for lid in (p, p + 1)]
    columns = [pa.array(list(c)) for c in zip(*rows)]
    columns[3] = columns[3].cast(pa.list_(pa.int64()))
    batch = pa.record_batch(columns, names=["piece", "lid", "root", "near", "line"])
    return {tuple(x.values()) for b in L._verify(iter([batch])) for x in b.to_pylist()}


@pytest.mark.parametrize(("spelt", "letters"), [(1 << 20, 1 << 12), (100, 1 << 12), (1 << 20, 12), (1 << 20, 2)])
def test_lines_verified_together_link_like_pairs(monkeypatch, spelt, letters):
    r = random.Random(12)
    lines = ["a", "ab", "ab\x00", "abcde", "abcdef", "a" * 50, "a" * 60]
    for _ in range(60):
        x = "".join(r.choices(r.choice(["ab", "cdef\u2019", "abcdefghijklmnop "]), k=r.randrange(1, 60)))
        lines += [x, x[: len(x) // 2] + "z" * r.randrange(2) + x[len(x) // 2 :]]
    monkeypatch.setattr(L, "SPELT", spelt)
    monkeypatch.setattr(L, "_LETTERS", np.uint64(letters))
    assert verified(lines) == {(k, k + 1) for k in range(len(lines) - 1) if jaccard(lines[k], lines[k + 1]) >= L.THRESHOLD}


def test_lines_are_spelt_together_and_single_bands_not_sorted(monkeypatch):
    # The cost of a line must not be that of many small array calls: 414 CPU seconds a GB once.
    calls, ordered = [], []
    spelt, lexsort = L._spelt, np.lexsort
    monkeypatch.setattr(L, "_spelt", lambda *a: calls.append(1) or spelt(*a))
    assert verified([f"a line of some words and letters, and at its end a number: {k}" for k in range(200)])
    assert len(calls) <= 2  # the last piece of a batch comes by itself
    rng = np.random.default_rng(6)
    bands = np.append(rng.permutation(np.arange(1, 5000, dtype=np.uint64)), np.uint64(7))
    blocks = pa.Table.from_batches([_block_rows(bands, rng.integers(1, 1 << 62, 5000).astype(np.uint64), 1)])
    monkeypatch.setattr(np, "lexsort", lambda keys: ordered.append(len(keys[0])) or lexsort(keys))
    assert [r["bucket"] for r in _merge_blocks(blocks).to_pylist()] == [7]
    assert ordered == [2]
    assert _merge_blocks(pa.Table.from_batches([_block_rows(bands[:-1], bands[:-1], 1)])).num_rows == 0
