import random
import zlib

import numpy as np

from quillmark.llm.packing import encoder, pack, shortest_pack_first

SCHEMA = "doc_id long, text string, length string, rank int, task int"


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    enc = encoder()
    bits = ["a", "Word", "d'été", "l'", "12", " ", "\n", "  ", "\t", " ", "€", "!!", "ß", "😀", "\r\n", "_", "½", "x's", "'ll", "\x00", "<|endoftext|>", "　", " \n"]
    texts = ["", " ", "\n", "a ", " a", "a\nb", "the cat's 12 hats.\nÉtait-ce ½ vrai?"] + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["the", "d'été,", "x's", "12a", "(b)", "_", "½"], k=20)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc(t), "<u4").tolist() == enc.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_patterns_place_every_length():
    rng = random.Random(2)
    for _ in range(200):
        hist = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        patterns = shortest_pack_first(hist, 64)
        placed = {}
        for p, n in patterns:
            assert n > 0 and sum(x * c for x, c in p) <= 64
            for x, c in p:
                placed[x] = placed.get(x, 0) + c * n
        assert placed == hist
    many = {x: 1000 for x in range(1, 1025)}
    total = sum(x * n for x, n in many.items())
    assert sum(n for _, n in shortest_pack_first(many)) <= 1.01 * total / 1024 + 1


def check(rows, got, context):
    enc = encoder()
    want = sorted((r[0] or -1, len(enc(r[1] or "")) // 4 + 1) for r in rows)
    assert sorted((r["id"] or -1, r["doc_tokens"]) for r in got if r["start"] == 0) == want
    texts = {r[0]: np.frombuffer(enc(r[1] or "") + bytes(4), "<u4") for r in rows}
    by = {}
    for r in got:
        ids = texts[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= context
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "word " * 20000, "é" * 5000] + [" ".join(rng.choices(["cat", "hat", "straßen"], k=rng.randint(0, 300))) for _ in range(120)]
    rows = [(i + 1, t, "x", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, "hat", "", 0, 0)], SCHEMA)
    rows = df.collect()
    for context in (64, 1024):
        n = check(rows, pack(df, context=context).collect(), context)
        tokens = sum(len(encoder()(r[1] or "")) // 4 + 1 for r in rows)
        assert n <= 1.02 * tokens / context + 2
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
