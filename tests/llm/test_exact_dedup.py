import hashlib
import random
import re

import numpy as np

from quillmark.llm.exact_dedup import CountingQuotientFilter, duplicate_groups, exact_dedup, repeated_fingerprints

SCHEMA = "doc_id long, text string, sha string, norm string, fp long"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b ", "A b", "a b", "x" * 100000, "x" * 100000]
    texts += ["hot text " * 3] * 60 + [" ".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i + 1, t, "c", "d", 9) for i, t in enumerate(texts)]
    got = duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in rows:
        by.setdefault(norm(r[1]), []).append(r[0])
    want = set()
    for r in rows:
        group = by[norm(r[1])]
        want.add((r[0], hashlib.sha256(norm(r[1]).encode()).hexdigest(), min(group), len(group), r[0] == min(group)))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = exact_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "sha", "norm", "fp"]
    assert sorted(r[0] for r in kept.collect()) == sorted(min(g) for g in by.values())


def test_empty_table_null_ids_repeated_rows(spark):
    assert duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "t", "", "", 0), (3, "t", "", "", 0), (3, "t", "", "", 0), (None, "u", "", "", 0)]
    found = duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in found} == {(None, 3, 3), (3, 3, 3), (None, None, 1)}
    assert sorted((r["id"] or 0, r["kept"]) for r in found) == [(0, False), (0, True), (3, False), (3, True)]
    assert exact_dedup(spark.createDataFrame(rows, SCHEMA)).count() == 2


def test_repeated_ids_and_clashing_names(spark):
    rows = [(7, "c", 1, 2), (7, "d", 1, 2), (8, "c ", 1, 2), (9, "c", 1, 2), (None, "e", 1, 2), (None, "f", 1, 2), (None, "e", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_of int, kept_mark int")
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "e"), (0, "f"), (7, "c"), (7, "d"), (8, "c ")]


def test_filter_round_trip_and_lossless_merge():
    rng = np.random.default_rng(2)
    for skip in (0, 5, 14):
        x = rng.integers(0, 2**63, 3000, dtype=np.uint64) << np.uint64(1)
        x = (x >> np.uint64(skip)) | (np.uint64(3) << np.uint64(64 - skip) if skip else np.uint64(0))
        x = np.concatenate([x, x[:900], x[:5].repeat(300)])
        parts = np.array_split(x, 7)
        made = [CountingQuotientFilter.build(*np.unique(p, return_counts=True), 3 if skip else 0, skip) for p in parts]
        assert sum(len(m.dumps()) for m in made) < 20 * len(x)
        whole = CountingQuotientFilter.loads(made[0].dumps())
        for m in made[1:]:
            whole = whole.merge(CountingQuotientFilter.loads(m.dumps()))
        fp, count = whole.items()
        want, n = np.unique(x, return_counts=True)
        assert np.array_equal(fp, want) and np.array_equal(count, n)


def test_repeated_fingerprints(spark):
    rows = [(x,) for x in [-(2**63), 2**63 - 1, 0, 0, -1, -1, -1, 5]]
    assert {tuple(r) for r in repeated_fingerprints(spark.createDataFrame(rows, "fp long")).collect()} == {(0, 2), (-1, 3)}
