import random

from quillmark.llm.quality_rules import STOP_WORDS, quality_figures, quality_filter

SCHEMA = "doc_id long, text string, n_words string, q_words string, id long"


def brute(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_stop_words": sum(x.rstrip(",.;:!?").lower() in STOP_WORDS for x in w),
        "base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w),
    }


def test_figures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n \n\nx", "é€😀 " * 60, "word" * 30000, "the of # " * 9000]
    for _ in range(60):
        words = rng.choices(["the", "Of,", "és", "x|y", "#", "dog", "cat", "<a>", "und", "lorem"], k=rng.randint(1, 300))
        texts.append("".join(x + rng.choice([" ", " ", "  ", "\n", "\t"]) for x in words))
    rows = [(i, t, "c", "d", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = quality_figures(df).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        want = brute(texts[r["id"]])
        assert {k: r[k] for k in want} == want, texts[r["id"]]
        assert not (r["kept"] and r["base_failed"])
    kept = quality_filter(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)


def test_clean_prose_stays_and_junk_goes(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.25 else f"w{rng.randint(0, 999)}" for _ in range(200))
    rows = [(1, prose), (2, " ".join(x + "###" for x in prose.split())), (3, prose.upper().replace(" ", "!! ")), (4, "same words here " * 40)]
    assert [r[0] for r in quality_filter(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]
    assert quality_figures(spark.createDataFrame([], SCHEMA)).count() == 0
