"""Operators on small inputs with results worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import canonical as C
from quillmark.functions import text as X
from quillmark.operators import admission, collections, graph, provenance, reviews, splits, state, textmetrics
from quillmark.plans import scratch
from quillmark.sources import sinks, tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_cleaning(spark):
    wrapped = "Title\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\n\r\nFirst  \r\n \r\n\r\nSecond\x00\r\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\r\nlicense"
    marked = "Produced by A\n\nA story.\n\nPAGE I. a II. b III. c\n\nIt ends."
    got = one(spark, C.clean_story(F.lit(" \r\na\rb\x00 ")), C.clean_wrapped(F.lit(wrapped)), C.clean_book(F.lit(wrapped)), C.drop_boilerplate(F.lit(marked)), C.clean_book(F.lit("no markers")))
    assert got == ("a\nb", "First\n\n\nSecond", "First\n\nSecond", "A story.\n\nIt ends.", "no markers")


def test_names_and_genres(spark):
    got = one(
        spark, C.title_genres(F.lit("The Haunted Detective Adventure")), C.broad_genres(F.array(F.lit("Ghost stories"), F.lit("Sea stories"))), C.control_token(F.array(F.lit("Gothic quest"))),
        C.normalized_name(F.lit("Poe, Edgar Allan, 1809-1849")), C.normalized_name(F.lit(None).cast("string")), C.safely_public(F.lit("Doyle, 1859-1930")), C.safely_public(F.lit("Someone, 1950-")), C.safely_public(F.lit("New, 1901-1990")),
        F.to_json(C.creators(F.lit("Poe, E. A. [Author]; Ed Itor [Editor]"))),
    )
    assert got == (["mystery", "horror", "adventure"], ["horror", "adventure"], "<|horror|>", "poe edgar allan", "unknown", True, False, False, '[{"name":"Poe, E. A.","role":"author"},{"name":"Ed Itor","role":"editor"}]')


def test_canonical_json(spark):
    import hashlib
    import json

    values = {"b": 'é"\\\n\x01😀', "a": "plain"}
    fields = {k: (F.lit(v), "string") for k, v in values.items()} | {"n": (F.lit(3), "int"), "z": (F.lit(None).cast("string"), "string")}
    want = values | {"n": 3, "z": None}
    got = one(spark, C.canonical_json(fields), C.json_line(fields), C.record_hash(fields), C.stable_seed(7, (F.lit("x"), "string")))
    text = json.dumps(want, sort_keys=True, separators=(",", ":"))
    assert got[0] == text and got[1] == json.dumps(want, ensure_ascii=False) + "\n" and got[2] == hashlib.sha256(text.encode()).hexdigest()
    assert int(got[3]) == int.from_bytes(hashlib.sha256(b'[7,"x"]').digest()[:8], "big")


BOOK = """A book

TABLE OF CONTENTS

The First Story .... 3
  II. The House of
  Sorrow
Last Light ..... 40

The First Story
one
two
The House of Sorrow

three
LAST LIGHT
four"""


def test_collections(spark):
    found, evidence = collections.spans(BOOK)
    assert [(s.title, s.text, s.confidence) for s in found] == [("The First Story", "one\ntwo", "high"), ("The House of Sorrow", "three", "high"), ("Last Light", "four", "high")]
    assert evidence["matched"] == 3 and collections.spans("no contents")[1]["confidence"] == "low"
    lost = BOOK.replace("LAST LIGHT", "Another")
    assert {s.confidence for s in collections.spans(lost)[0]} == {"medium"}
    rows = collections.extracted(spark.createDataFrame([(1, BOOK), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    assert len(rows) == 3 and rows[0]["before"].endswith("Last Light ..... 40\n")


def test_rejections(spark):
    prose = ("word " * 20 + ".\n\n") * 30
    texts = {
        "ok": ("A tale", prose, None, None), "title": ("Preface", prose, "front_or_back_matter_title", None), "chapter": ("Chapter IV", prose, None, "chapter_or_structural_title"),
        "short": ("T", "few words", "too_short_or_front_matter", "too_short_or_front_matter"), "one": ("T", "word " * 600, "insufficient_prose_paragraphs", "insufficient_prose_paragraphs"),
        "chapters": ("T", "Chapter 1\nPart II.\nBOOK 3\n" + prose, None, "probable_novel_chapter_contamination"), "glyphs": ("T", prose + "a|b c1d2e3 " * 20, None, "damaged_ocr_suspicious_tokens"),
        "verse": ("T", "a short line of words\n\n" * 200, "probable_poetry", "probable_poetry"), "digits": ("T", "12345 " * 600 + "\n\na\n\nb", "damaged_ocr_or_nonprose", "damaged_ocr_or_nonprose"),
    }
    df = spark.createDataFrame([(k, t, x) for k, (t, x, _, _) in texts.items()], "k string, title string, text string")
    df = df.select("k", "title", *(c.alias(n) for n, c in admission.figures(F.col("text")).items()))
    got = {r["k"]: (r["v1"], r["v2"]) for r in df.select("k", admission.rejection_v1(F.col("title")).alias("v1"), admission.rejection_v2(F.col("title")).alias("v2")).collect()}
    assert got == {k: (a, b) for k, (_, _, a, b) in texts.items()}


def test_signals_and_funnel(spark):
    text = "� [Transcriber's note] Project Gutenberg hy-\nphen {x} w0rd 3rd"
    got = one(spark, *(c.alias(n) for n, c in admission.ocr_signals(F.lit(text)).items()))
    assert got == (1, 1, 1, 1, 2, 2)
    rows = [(1, None, 5), (2, "too_short", 1), (3, "too_short", 2)]
    out = admission.funnel(spark.createDataFrame(rows, "doc_id long, reason string, n_words long"))
    assert {tuple(r) for r in out.collect()} == {("admitted", 1, 5), ("too_short", 2, 3)}
    with pytest.raises(Exception, match="decided more than once"):
        admission.funnel(spark.createDataFrame([*rows, (3, None, 2)], "doc_id long, reason string, n_words long")).collect()


def test_quote_spans():
    assert textmetrics.quote_spans("“one two” said he. “three”") == (3, 0, 0, 0)
    assert textmetrics.quote_spans("“one two\n\n“three four”") == (4, 1, 0, 0)
    assert textmetrics.quote_spans("“one ‘two three’ four”") == (4, 0, 0, 0)
    assert textmetrics.quote_spans('"open words and no end') == (0, 0, 1, 0)
    assert textmetrics.quote_spans("the dog’s bone” here") == (0, 0, 0, 1)


def test_longest_span_is_brute_force():
    def brute(ids):
        for width in range(len(ids) // 2, 0, -1):
            first = {}
            for i in range(len(ids) - width + 1):
                k = tuple(ids[i : i + width])
                if k in first and i - first[k] >= width:
                    return width
                first.setdefault(k, i)
        return 0

    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        assert textmetrics.longest_repeated_span(ids) == brute(ids), ids


def test_mentions_and_arrays(spark):
    words = lambda s: textmetrics.fact_words(F.lit(s))
    m = textmetrics.mention(words("the key is not red ; not blue, and red is never won"), words("red"))
    said = textmetrics.asserted(F.lit("The titleholder Ann was the red fox. Nothing."), words("red fox"), F.array(F.lit("Ann")), F.lit("titleholder"), ("was",))
    got = one(
        spark, m["mentioned"], m["negated"], said, textmetrics.contains_phrase(F.lit("A  Red\nfox."), words("red fox")), textmetrics.contains_run(F.array(*map(F.lit, "abcab")), F.array(F.lit("c"), F.lit("a"))),
        textmetrics.first_divergence(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd"))), textmetrics.first_divergence(F.array(F.lit("a")), F.array(F.lit("a"))),
        textmetrics.inside_dialogue(F.lit("“a” “b")), textmetrics.inside_dialogue(F.lit('"a" “b”')),
    )
    assert got == (True, True, True, True, True, 2, None, True, False)
    left, right = F.lit("He said so.\n\n"), F.lit("“Yes")
    flags = textmetrics.boundary_flags(left, right, F.lit(False))
    assert one(spark, flags["primary"], flags["sentence"], flags["dialogue"]) == ("paragraph", True, True)


def test_components_and_joins(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 340)] + [(None, 1), (5, 5)]
    label = {n: n for e in rows for n in e if n is not None}
    for a, b in rows:
        if a is not None:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    want = {n: r for n, r in label.items() if any(n in e and e[0] is not None and e[0] != e[1] for e in rows)}
    edges = spark.createDataFrame(rows, "a long, b long")
    assert {r["node"]: r["root"] for r in graph.connected_components(edges).collect()} == want
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(scratch, "HOT_SHARE", 0.0)
    assert {r["node"]: r["root"] for r in graph.connected_components(edges).collect()} == want
    left = spark.createDataFrame([(1, "a")] * 1200 + [(2, "b"), (3, "c")], "k long, x string")
    right = spark.createDataFrame([(1, 1200, "hot"), (2, 1, "cold")], "k long, n long, y string")
    got = scratch.weighted_join(left, right, "k", "n", 1202, "left").groupBy("k", "y").count().collect()
    assert {tuple(r) for r in got} == {(1, "hot", 1200), (2, "cold", 1), (3, None, 1)}


def test_subsets_and_quotas(spark):
    assert splits.subset([5, 3, 4], 7) == [1, 2] and splits.subset([5], 3) is None and splits.subset([], 0) == []
    rows = [(f"{i}", "a" if i % 2 else "b", str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, x string, y string")
    quotas = {"x": {"a": 3, "b": 3}, "y": {"0": 2, "1": 2, "2": 2}}
    got = {r["id"] for r in reviews.quota_select(df, quotas, 5).collect()}
    chosen = [r for r in rows if r[0] in got]
    assert len(chosen) == 6 and all(sum(r[1] == k for r in chosen) == n for k, n in quotas["x"].items()) and all(sum(r[2] == k for r in chosen) == n for k, n in quotas["y"].items())
    with pytest.raises(ValueError):
        reviews.quota_select(df, {"x": {"a": 1}, "y": {"7": 1}}, 5, attempts=2)


def test_taxonomy(spark):
    got = one(spark, *(state.categories(F.lit(v), F.lit("c"), F.lit("b"), F.lit("a"), F.lit(p), F.lit(5)) for v, p in (("c", 4), ("b", 2), ("a", 1), ("z", 9), ("m", 3))))
    assert got == (["CURRENT"], ["PREVIOUS", "OLDER"], ["INITIAL", "OLDER"], ["NEVER_VALID"], ["OLDER"])


def test_dates_and_exclusions(spark):
    dates = ["2026-10-12", "2026-10-12T10:00:00Z", "2026-10-13", "2026-13-01", "x", "", None]
    assert one(spark, *(provenance.valid_date(F.lit(d).cast("string")) for d in dates)) == (True, True, False, False, False, False, False)
    schema = "id string, decision string, reviewer string, reviewed_at string, rationale string"
    good = ("a", "exclude", "me", "2026-01-01", "same story")
    assert [r["id"] for r in provenance.review_exclusions(spark.createDataFrame([good], schema)).collect()] == ["a"]
    for bad in ([good, good], [("b", "keep", "me", "2026-01-01", "x")], [("b", "exclude", "", "2026-01-01", "x")]):
        with pytest.raises(Exception, match="excluded twice|an exclusion lacks"):
            provenance.review_exclusions(spark.createDataFrame(bad, schema)).collect()


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id":"a","title":"T","text":"x"}\n\n{"id":"b","title":"U","text":"é"}\n', encoding="utf-8")
    schema, need = "id string, title string, text string", ("id", "title", "text")
    assert tables.read_corpus(spark, str(p), schema, need).count() == 2
    for broken, why in (('{"id":"a","title":"T","text":"x"}\n{"id":"a","title":"T","text":"y"}', "repeated id: a"), ("", "no records"), ('{"id":"a","title":" ","text":"x"}', "blank title"), ('{"id":"a"\n', "not a record")):
        p.write_text(broken)
        with pytest.raises(Exception, match=why):
            tables.read_corpus(spark, str(p), schema, need).collect()
    assert [r["line"] for r in tables.bad_lines(spark, str(p), schema).collect()] == ['{"id":"a"']
    c = tmp_path / "c.csv"
    c.write_bytes("\ufeffText#,Title\n7,\"A, B\"\n".encode())
    assert [tuple(r) for r in tables.read_catalog(spark, str(c), "Text#", "pg-").collect()] == [("7", "A, B", "pg-7")]
    files = tables.artifact_manifest(spark, str(tmp_path / "c.csv"))
    locked = files.select("path", "sha256")
    assert tables.accepted_artifacts(files, locked).count() == 1
    with pytest.raises(Exception, match="changed or missing"):
        tables.accepted_artifacts(files, locked.withColumn("sha256", F.lit("0"))).collect()
    df = spark.createDataFrame([(1, "é")], "n long, s string")
    sinks.write_jsonl(df, str(tmp_path / "out"), {"s": (F.col("s"), "string"), "n": (F.col("n"), "long")})
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"n":1,"s":"\\u00e9"}']
    sinks.write_json(spark, str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'
    schedule = spark.range(3).withColumnRenamed("id", "ordinal")
    assert sinks.write_schedule(schedule, str(tmp_path / "s1")) == sinks.write_schedule(schedule, str(tmp_path / "s2"))


def test_split_words_and_lines(spark):
    text = "a\u00a0b  c\r\nd\x0be\n"
    got = one(spark, X.split_words(F.lit(text)), X.split_lines(F.lit(text)), X.strip(F.lit(" \u3000x\n")), X.word_count(F.lit("a b\tc")))
    assert got == (text.split(), text.splitlines(), "x", 3)
