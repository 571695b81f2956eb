import random

import numpy as np
import xxhash

from quillmark.llm.simhash_vp import VantageTree, shard_links, simhash_components, simhash_dedup

SCHEMA = "doc_id long, text string, fp string, id int"


def brute(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {d: d for d, _ in fps}
    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= 3:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [None, "", " \t\n", "a", "A b", "a b c", "a  b\nc", "x " * 5000, "x" * 40000]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return [(i * 7 + 1, t, "clash", i) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [(r[0], brute(r[1])) for r in rows]
    want = brute_components(fps)
    assert got == {d: (f, want[d]) for d, f in fps}
    assert len(set(want.values())) < len(want)
    kept = simhash_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "id"]
    assert sorted(r[0] for r in kept.collect()) == sorted(set(want.values()))


def test_empty_null_ids_and_repeats(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", "", 1), (4, "a b c d", "", 2), (4, "a b c d", "", 2), (None, "q r s t u", "", 3)]
    got = simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert simhash_dedup(spark.createDataFrame(rows, SCHEMA)).count() == 2
    apart = ["one two three four five", "six seven eight nine ten", "red green blue grey pink", "north south east west up"]
    rows = [(None, apart[0], "", 1), (None, apart[1], "", 1), (7, apart[2], "", 1), (7, apart[3], "", 1), (7, apart[3], "", 1)]
    assert sorted(r["text"] for r in simhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(apart)


def test_forest_and_shards_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:400].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    cluster = base[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near, cluster]))
    pairs = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3), strict=True) if i < j}
    for mask in (0xFFFFFFFF00000000, 0x00000000FFFFFFFF):
        tree = VantageTree(x[::3], mask, 1, 16)
        leaf, idx, guest = tree.route(x)
        assert tree.leaves > 4
        assert sorted(idx[~guest]) == list(range(len(x)))
        met = set()
        for k in range(tree.leaves):
            home, every = idx[(leaf == k) & ~guest], idx[leaf == k]
            met |= {(min(a, b), max(a, b)) for a in home for b in every}
        near_here = {p for p in pairs if (int(x[p[0]] ^ x[p[1]]) & mask).bit_count() <= 1}
        assert near_here <= met
    i, j = shard_links(x, x[:0], 0xFFFFFFFF00000000, 1)
    assert all((min(a, b), max(a, b)) in pairs or a != b for a, b in zip(i, j, strict=True))
