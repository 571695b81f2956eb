import math
import random
import zlib
from collections import Counter

from quillmark.llm import kneser_ney
from quillmark.llm.kneser_ney import held_out_scores

SCHEMA = "doc_id long, text string, score string, n_tokens int"


def brute(rows):
    seqs = {r[0]: [w.decode() for w in (r[1] or "").encode().lower().split()] + [" "] for r in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in seqs}
    uni, tri, first = Counter(), Counter(), Counter()
    for r in rows:
        if not out[r[0]]:
            s = ["  ", *seqs[r[0]]]
            uni.update(s[1:])
            first[s[1]] += 1
            tri.update(zip(s, s[1:], s[2:], strict=False))
    N, V = sum(uni.values()), len(uni)
    big = Counter((v, w) for _, v, w in tri)
    big.update({("  ", w): c for w, c in first.items()})
    one = Counter(w for _, w in big)
    of = lambda counts: kneser_ney._discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])

    def level(grams):
        d, total, gamma = of(grams.values()), Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            gamma[g[:-1]] += d[min(c, 3) - 1]
        return lambda g, below: (max(0, grams[g] - (d[min(grams[g], 3) - 1] if grams[g] else 0)) + gamma[g[:-1]] * below) / total[g[:-1]] if total[g[:-1]] else below

    l1, l2, l3 = level(Counter({(w,): c for w, c in one.items()})), level(big), level(tri)
    p2 = lambda v, w: l2((v, w), l1((w,), 1 / (V + 1)))
    p3 = lambda u, v, w: l3((u, v, w), p2(v, w))
    for u, v in [("  ", "the"), ("the", "of"), ("unseen", "the"), ("the", "unseen"), *list(tri)[:5]][:4]:
        assert abs(sum(p3(u, v, w) for w in uni) + p3(u, v, "never seen") - 1) < 1e-9
    res = {}
    for d, s in seqs.items():
        p = [p2("  ", s[0])] + [p3(u, v, w) for u, v, w in zip(["  ", *s], s, s[1:], strict=False)]
        res[d] = (out[d], len(s), sum(uni[w] > 0 for w in s), N, sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in s), sum(map(math.log10, p)))
    return res


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["The", "of", "É", "x-y", *(f"w{i}" for i in range(300))]
    texts = [None, "", " \t", "The", "W" * 70000, "the of " * 3000] + [" ".join(rng.choices(vocab, weights=[90, 60, 20, 9, *[1] * 300], k=rng.randint(0, 200))) for _ in range(120)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    want = brute(rows)
    for run, heavy in ((kneser_ney.RUN, kneser_ney.HEAVY), (500, 3)):
        monkeypatch.setattr(kneser_ney, "RUN", run)
        monkeypatch.setattr(kneser_ney, "HEAVY", heavy)
        got = held_out_scores(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r["id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert abs(r["base_score"] - w[4]) < 1e-6 * (1 + abs(w[4])) and abs(r["score"] - w[5]) < 1e-6 * (1 + abs(w[5]))


def test_edges(spark):
    assert held_out_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = held_out_scores(spark.createDataFrame([(alone, "a b", "", 0)], SCHEMA)).collect()[0]
    assert (r["held_out"], r["n_known"], r["train_tokens"], r["score"]) == (True, 0, 0, 0.0)
    same = [(None, "a b", "", 0), (1, "a b", "", 0), (1, "a b", "", 0)]
    assert held_out_scores(spark.createDataFrame(same, SCHEMA)).count() == 3
