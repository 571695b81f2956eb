"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import random
import re
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from quillmark.llm.mixing import mix, mixed_documents
from quillmark.llm.packing import encoder
from quillmark.llm.quality_rules import quality_figures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_id int"


def fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def documents():
    rng = random.Random(9)
    vocab = "the of and to in is that it on was for with as his they be at one have this".split() + ["w%d" % i for i in range(300)]
    weights = [6] * (len(vocab) - 300) + [1] * 300
    rows = [(1, None, "en", "a", 0, 7), (2, "", "en", "a", 0, 7), (3, "too short", "en", "b", 9, 7), (4, "!!! ### " * 60, "en", "b", 0, 7)]
    for i in range(10, 70):
        text = " ".join(rng.choices(vocab, weights, k=rng.choice([60, 80, 150, 1500])))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", None]), len(text), 7))
        if rng.random() < 0.3:
            rows.append((i + 100, text.replace(" ", "  ", 3), "en", "c", len(text) + 3, 7))  # equal once squeezed
        if rng.random() < 0.3:
            words = text.split()
            words[len(words) // 2] = "changed"
            rows.append((i + 200, " ".join(words), "en", "c", 0, 7))
    return rows


def test_the_whole_matches_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = {r["id"] for r in quality_figures(docs).where("kept").collect()}
    assert not good & {1, 2, 3, 4} and len(good) > 40
    first = {}
    for r in sorted(rows):
        if r[0] in good:
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    left = sorted(first.values())
    prints = {r[0]: fingerprint(r[1]) for r in left}
    label = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    kept = [r for r in left if label[r[0]] == r[0]]
    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (good, {r[0] for r in left}, {r[0] for r in kept}), strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert sorted(r["doc_id"] for r in now.collect()) == sorted(want)
    taken = {r["id"]: r["taken"] for r in mix(now).collect()}
    mixed = corpus_pipeline.mixture(spark, now, str(tmp_path)).collect()
    words, texts = {}, {r[0]: r[1] for r in kept}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
        whole = iter(texts[r["doc_id"]].split())
        assert all(w in whole for w in r["text"].split())  # its words, in their order
    assert words == {i: n for i, n in taken.items() if n}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = encoder()
    want = {}
    for r in mixed:
        ids = np.frombuffer(encode(r["text"]), "<u4").tolist() + [0]
        for at in range(0, len(ids), 1024):
            part = np.array(ids[at : at + 1024], "<u4")
            key = (r["doc_id"], at, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        found[key] = found.get(key, 0) + 1
    assert found == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_nothing_and_odd_rows(spark, tmp_path):
    for rows in ([], [(None, None, None, None, None, None)] * 2 + [(5, "a b", "x", None, 3, 1)] * 2):
        df = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, df, "")
            assert out.columns == df.columns and out.count() <= 6
        assert corpus_pipeline.packing(spark, df, "").count() == len(rows)
    odd = spark.createDataFrame([(None, "a b c", "x", "s", 5, 1), (None, "d e f", "x", "s", 5, 1)], SCHEMA)
    assert sorted(r["text"] for r in mixed_documents(odd).distinct().collect()) == ["a b c", "d e f"]
