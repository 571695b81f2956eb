import random

from quillmark.llm.mixing import mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size int, taken string"


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for source, n in (("b", 400), (None, 40), ("a", 60), ("é", 30), ("z", 5)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.choice([0, 3, 40, 200, 3000])), source, 1, ""))
            i += 1
    rows.append((i, None, "b", 1, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == {tuple(r) for r in mix(df).collect()}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 5, (s, taken[s], t)
    whole = mixed_documents(df)
    assert whole.columns == df.columns
    words = {}
    for r in whole.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert abs(words["b"] - want["b"]) < 0.2 * want["b"]


def test_empty_wordless_and_repeated(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, 0, ""), (None, " ", "a", 0, "")], SCHEMA)
    assert [r["taken"] for r in mix(nothing).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b c", "s", 0, "")] * 4 + [(2, "", "s", 0, "")] * 3, SCHEMA)
    got = mix(same).collect()
    assert len(got) == 7 and sum(r["taken"] for r in got) == 12
    assert mixed_documents(same).count() >= 1
