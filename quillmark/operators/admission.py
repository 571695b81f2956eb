"""Ordered first-failing-rule admission, exact-duplicate decisions, funnels and text signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import weighted_join, written
from ..sources.tables import table

# Headings that are no story's title, structural titles and lines, the tokens
# of damaged text, and the two generations' limits of words.
NON_STORY_TITLE = (
    r"(?i)^(?:preface|foreword|introduction\b.*|contents|acknowledgements?|bibliography|index|notes?|glossary|appendix|(?:a )?(?:short )?history\b.*"
    r"|about the author|illustrations?|transcriber'?s notes?|.*\b(?:article|obituaries|bibliography)\b.*)$"
)
STRUCTURAL_TITLE = r"(?i)^(?:(?:chapter|part|book|volume|section)\s+(?:[ivxlcdm]+|\d+)(?:\b.*)?|[ivxlcdm]+|\d+)$"
STRUCTURAL_LINE = r"(?i)^\s*(?:chapter|part|book|volume)\s+(?:[ivxlcdm]+|\d+)\s*[.:~-]*\s*$"
SUSPICIOUS = r"\b\w*[|{}<>]\w*\b|(?:\S*\d){3,}\S*"
V1_WORDS, V2_WORDS = (500, 10_000), (500, 20_000)
MOST_SHORT_LINES, SHORT_LINE, FEWEST_ALPHABETIC = 0.72, 8, 0.65
#: What the registered queries take, as the corpus here has short texts and no blank lines.
QUERY_WORDS, QUERY_BREAK = (50, 20_000), r"\n"


def heading(title: Column) -> Column:
    """Normalised heading: straight quotes, lower case, runs of letters and digits."""
    straight = F.translate(X.body(title), "’‘“”", "''\"\"")
    folded = F.replace(F.lower(straight), F.lit("ß"), F.lit("ss"))
    return F.array_join(F.regexp_extract_all(folded, F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0)), " ")


def figures(text: Column, blank_line: str = r"\n\s*\n") -> dict[str, Column]:
    """What the rules ask about a text, each a plain expression over it.

    ``blank_line`` separates paragraphs.
    """
    raw = X.body(text)
    line = F.filter(F.transform(X.split_lines(raw), X.strip), lambda x: x != "")
    words_of = lambda x: F.size(F.split(F.regexp_replace(x, f"{X.SPACE}+", " "), " "))
    odd = F.filter(F.split(raw, f"{X.SPACE}+"), lambda t: t.rlike(r"[|{}<>]|\d\D*\d\D*\d"))
    return {
        "n_words": X.word_count(text),
        "n_chars_all": F.length(raw).cast("long"),
        "n_chapters": F.size(F.filter(X.split_lines(raw), lambda x: x.rlike(STRUCTURAL_LINE))).cast("long"),
        "n_paragraphs": F.size(F.filter(F.split(raw, blank_line, -1), lambda x: X.strip(x) != "")).cast("long"),
        "n_letters": X.count_of(raw, r"\p{L}").cast("long"),
        "n_visible": X.count_of(raw, X.NO_SPACE).cast("long"),
        "n_replacements": (F.length(raw) - F.length(F.replace(raw, F.lit("�"), F.lit("")))).cast("long"),
        "n_suspicious": F.aggregate(F.transform(odd, lambda t: F.regexp_count(t, F.lit(SUSPICIOUS))), F.lit(0), lambda a, x: a + x).cast("long"),
        "n_lines": F.size(line).cast("long"),
        "n_short_lines": F.size(F.filter(line, lambda x: words_of(x) <= SHORT_LINE)).cast("long"),
    }


def _damaged() -> Column:
    return (F.col("n_visible") > 0) & (F.col("n_letters") / F.col("n_visible") < FEWEST_ALPHABETIC)


def _poetry() -> Column:
    return (F.col("n_lines") >= 20) & (F.col("n_short_lines") / F.greatest(F.lit(1), F.col("n_lines")) > MOST_SHORT_LINES)


def rejection_v1(title: Column, limits: tuple[int, int] = V1_WORDS) -> Column:
    """First failing rule of generation 1 over the columns of ``figures`` (null: none)."""
    return (
        F.when(heading(title).rlike(NON_STORY_TITLE), "front_or_back_matter_title")
        .when(F.col("n_words") < limits[0], "too_short_or_front_matter")
        .when(F.col("n_words") > limits[1], "too_long_possible_novel_or_section")
        .when(F.col("n_paragraphs") < 3, "insufficient_prose_paragraphs")
        .when(_damaged(), "damaged_ocr_or_nonprose")
        .when(_poetry(), "probable_poetry")
    )


def rejection_v2(title: Column, limits: tuple[int, int] = V2_WORDS) -> Column:
    """First failing rule of generation 2 over the columns of ``figures`` (null: none)."""
    return (
        F.when(heading(title).rlike(STRUCTURAL_TITLE), "chapter_or_structural_title")
        .when(F.col("n_words") < limits[0], "too_short_or_front_matter")
        .when(F.col("n_words") > limits[1], "too_long_possible_novel")
        .when(F.col("n_chapters") >= 3, "probable_novel_chapter_contamination")
        .when(F.col("n_paragraphs") < 3, "insufficient_prose_paragraphs")
        .when(_damaged(), "damaged_ocr_or_nonprose")
        .when(F.col("n_replacements") / F.greatest(F.lit(1), F.col("n_chars_all")) > 0.001, "damaged_ocr_replacement_characters")
        .when(F.col("n_suspicious") > F.greatest(F.lit(8), F.floor(F.col("n_words") / 100)), "damaged_ocr_suspicious_tokens")
        .when(_poetry(), "probable_poetry")
    )


def title_of(text: Column) -> Column:
    """The first line, as documents have no title of their own."""
    return F.substring_index(X.body(text), "\n", 1)


def exact_winners(hashed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, text_hash, ...) + winner_id and group_size: the smallest key of a hash wins.

    ``hashed`` is a written table; a hash that very many rows share meets in no task.
    """
    groups = hashed.groupBy("text_hash").agg(F.min(key).alias("winner_id"), F.count("*").alias("group_size"))
    return weighted_join(hashed, groups, "text_hash", "group_size", hashed.count())


def admission(docs: DataFrame, limits: tuple[int, int] = V2_WORDS, blank_line: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, source, lang, n_words, reason): rule first, duplicate only if no rule applies.

    Texts are read once; rules and duplicates work on the written figures.
    """
    text = F.col("text")
    known = docs.select("doc_id", "source", "lang", title_of(text).alias("title"), X.text_hash(text).alias("text_hash"), *(c.alias(n) for n, c in figures(text, blank_line).items()))
    judged = written(known.withColumn("reason", rejection_v2(F.col("title"), limits)).select("doc_id", "source", "lang", "n_words", "text_hash", "reason"), "judged")
    won = exact_winners(judged.where("reason IS NULL"))
    won = won.withColumn("reason", F.when(F.col("doc_id") != F.col("winner_id"), "exact_duplicate"))
    columns = ["doc_id", "source", "lang", "n_words", "reason"]
    return judged.where("reason IS NOT NULL").select(columns).union(won.select(columns))


def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission(table(spark, sf_dir, "documents"), QUERY_WORDS, QUERY_BREAK)


def funnel(decisions: DataFrame) -> DataFrame:
    """(decision, records, words) of every reason and of what is admitted.

    Fails if the candidates are not the admitted and the rejected, each once.
    """
    out = decisions.groupBy(F.coalesce("reason", F.lit("admitted")).alias("decision")).agg(F.count("*").alias("records"), F.sum("n_words").alias("words"))
    once = decisions.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    again = once.select(F.raise_error(F.concat(F.lit("decided more than once: "), F.col("doc_id").cast("string"))).cast("string").alias("decision"))
    return out.unionByName(again.select("decision", F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("words")))


def admission_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(admission_decisions(spark, sf_dir))


def story_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both generations' verdicts with their own limits, lines standing for paragraphs."""
    text = F.col("text")
    known = table(spark, sf_dir, "documents").select("doc_id", title_of(text).alias("title"), *(c.alias(n) for n, c in figures(text, QUERY_BREAK).items()))
    return written(known, "figures").select("doc_id", rejection_v1(F.col("title")).alias("v1"), rejection_v2(F.col("title")).alias("v2"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash")), "hashes")


def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_winners(_hashed(spark, sf_dir)).select(
        "doc_id", "text_hash", "winner_id", "group_size", (F.col("doc_id") == F.col("winner_id")).alias("retained")
    )


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per loser: the winner, and whether it won as a labelled (base) document.

    Labelled documents come first, so they are preferred; ties go by id.
    """
    base = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("is_base", F.lit(True))
    rows = _hashed(spark, sf_dir).join(base, "doc_id", "left").withColumn("is_base", F.coalesce("is_base", F.lit(False)))
    rows = written(rows, "ranked")
    first = F.min(F.struct((~F.col("is_base")).alias("later"), F.col("doc_id"))).alias("first")
    groups = rows.groupBy("text_hash").agg(first, F.count("*").alias("n")).where("n > 1")
    out = weighted_join(rows, groups, "text_hash", "n", rows.count()).where("doc_id <> first.doc_id")
    won = F.when(F.col("first.later"), "exact_normalized_text_match_first_seen_preferred").otherwise("exact_normalized_text_match_base_preferred")
    return out.select("text_hash", F.col("first.doc_id").alias("retained_id"), F.col("doc_id").alias("rejected_id"), (~F.col("first.later")).alias("retained_is_base"), won.alias("reason"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_hash, doc_id, members): the documents of every group of two or more, a row each."""
    return exact_winners(_hashed(spark, sf_dir)).where("group_size > 1").select("text_hash", "doc_id", F.col("group_size").alias("members"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal raw text, normalised text, opening, and (title, source): kind, groups, documents."""
    text = F.col("text")
    opening = F.array_join(F.slice(X.words(text), 1, 40), " ")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    title = F.concat_ws("\x00", heading(title_of(text)), F.coalesce("source", F.lit("")))
    kinds = {"raw": sha(X.body(text)), "normalized": X.text_hash(text), "opening": sha(opening), "title_source": sha(title)}
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()))
    d = table(spark, sf_dir, "documents").select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))
    return d.where("n > 1").groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("documents"), F.max("n").alias("largest"))


def ocr_signals(text: Column) -> dict[str, Column]:
    """Counts of each signal of damaged or editorial text."""
    return {n: F.regexp_count(X.body(text), F.lit(p)).cast("long") for n, p in X.OCR_PATTERNS}


def ocr_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in ocr_signals(F.col("text")).items()))


def ocr_document_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, _ in X.OCR_PATTERNS]
    long = ocr_signal_counts(spark, sf_dir).unpivot("doc_id", names, "signal", "hits")
    return long.groupBy("signal").agg(
        F.count_if(F.col("hits") > 0).alias("documents"), F.sum("hits").alias("hits"),
        F.round(F.count_if(F.col("hits") > 0) / F.count("*"), 9).alias("rate"),
    )


def line_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.lines(F.col("text")).alias("l"))
    docs = docs.select("doc_id", F.size("l").cast("long").alias("lines"), F.size(F.array_distinct("l")).cast("long").alias("distinct_lines"))
    return docs.withColumn("repeated", F.col("lines") - F.col("distinct_lines"))


_T = "coalesce(text, '')"
_LINES = X.sql_split_lines("t")
_VISIBLE = f"len(regexp_extract_all(t, '{X.NO_SPACE}'))"


def _figures_sql(blank_line: str) -> str:
    return rf"""
  SELECT *, {X.SQL_COUNT} AS n_words, len(list_filter(ls, lambda x: regexp_matches(x, '{STRUCTURAL_LINE}'))) AS n_chapters,
    len(list_filter(string_split_regex(t, '{blank_line}'), lambda x: {X.sql_strip("x")} <> '')) AS n_paragraphs,
    {_VISIBLE} AS n_visible, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters, len(t) - len(replace(t, chr(65533), '')) AS n_replacements,
    list_sum(list_transform(list_filter(regexp_extract_all(t, '{X.NO_SPACE}+'), lambda x: regexp_matches(x, '[|{{}}<>]|\d\D*\d\D*\d')), lambda x: len(regexp_extract_all(x, '{SUSPICIOUS}')))) AS s,
    list_filter(ls, lambda x: {X.sql_strip("x")} <> '') AS l
  FROM (SELECT *, {_LINES} AS ls, regexp_replace(split_part(t, chr(10), 1), '', '') AS title FROM (SELECT *, {_T} AS t FROM documents))"""


_SHORT = f"len(list_filter(l, lambda x: len(regexp_extract_all(x, '{X.NO_SPACE}+')) <= {SHORT_LINE}))"
_HEADING = "array_to_string(regexp_extract_all(replace(lower(translate(title, '’‘“”', '''''\"\"')), 'ß', 'ss'), '[a-z0-9]+(?:''[a-z0-9]+)?'), ' ')"
_DAMAGED = f"n_visible > 0 AND n_letters / n_visible < {FEWEST_ALPHABETIC}"
_POETRY = f"len(l) >= 20 AND {_SHORT} / greatest(1, len(l)) > {MOST_SHORT_LINES}"


def _v2_sql(limits: tuple[int, int]) -> str:
    return f"""CASE WHEN regexp_matches({_HEADING}, '{STRUCTURAL_TITLE}') THEN 'chapter_or_structural_title'
    WHEN n_words < {limits[0]} THEN 'too_short_or_front_matter' WHEN n_words > {limits[1]} THEN 'too_long_possible_novel'
    WHEN n_chapters >= 3 THEN 'probable_novel_chapter_contamination' WHEN n_paragraphs < 3 THEN 'insufficient_prose_paragraphs'
    WHEN {_DAMAGED} THEN 'damaged_ocr_or_nonprose' WHEN n_replacements / greatest(1, length(t)) > 0.001 THEN 'damaged_ocr_replacement_characters'
    WHEN coalesce(s, 0) > greatest(8, n_words // 100) THEN 'damaged_ocr_suspicious_tokens' WHEN {_POETRY} THEN 'probable_poetry' END"""


_V1_SQL = f"""CASE WHEN regexp_matches({_HEADING}, '{NON_STORY_TITLE.replace("'", "''")}') THEN 'front_or_back_matter_title'
    WHEN n_words < {V1_WORDS[0]} THEN 'too_short_or_front_matter' WHEN n_words > {V1_WORDS[1]} THEN 'too_long_possible_novel_or_section'
    WHEN n_paragraphs < 3 THEN 'insufficient_prose_paragraphs' WHEN {_DAMAGED} THEN 'damaged_ocr_or_nonprose' WHEN {_POETRY} THEN 'probable_poetry' END"""
_ADMISSION = f"""WITH f AS ({_figures_sql(QUERY_BREAK)}), judged AS (SELECT *, {_v2_sql(QUERY_WORDS)} AS rule FROM f
), ranked AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {X.SQL_HASH}) AS winner FROM judged WHERE rule IS NULL
), admission AS (
  SELECT j.doc_id, source, lang, n_words, coalesce(rule, CASE WHEN winner <> j.doc_id THEN 'exact_duplicate' END) AS reason
  FROM judged j LEFT JOIN ranked r ON r.doc_id = j.doc_id
)"""
_HASHES = f"SELECT doc_id, {X.SQL_HASH} AS text_hash FROM documents"

QUERIES = {
    "admission_funnel": admission_funnel, "admission_decisions": admission_decisions, "story_rejections": story_rejections,
    "exact_duplicate_winners": duplicate_decisions, "exact_duplicate_groups": duplicate_groups, "exact_duplicate_report": duplicate_report,
    "duplicate_keys": duplicate_keys, "ocr_signal_counts": ocr_signal_counts, "ocr_document_rates": ocr_document_rates, "line_repetition": line_repetition,
}
_SIGNALS = ", ".join(f"len(regexp_extract_all({_T}, '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT AS {n}" for n, p in X.OCR_PATTERNS)
_KINDS = {
    "raw": f"sha256({_T})", "normalized": X.SQL_HASH, "opening": f"sha256(array_to_string({X.SQL_WORDS}[1:40], ' '))",
    "title_source": f"sha256({_HEADING.replace('title,', 'split_part(' + _T + ', chr(10), 1),')} || chr(0) || coalesce(source, ''))",
}
ORACLE_SQL = {
    "admission_funnel": f"{_ADMISSION} SELECT coalesce(reason, 'admitted') AS decision, count(*) AS records, sum(n_words)::BIGINT AS words FROM admission GROUP BY 1",
    "admission_decisions": f"{_ADMISSION} SELECT * FROM admission",
    "story_rejections": f"WITH f AS ({_figures_sql(QUERY_BREAK)}) SELECT doc_id, {_V1_SQL} AS v1, {_v2_sql(V2_WORDS)} AS v2 FROM f",
    "exact_duplicate_winners": f"WITH h AS ({_HASHES}) SELECT doc_id, text_hash, min(doc_id) OVER w AS winner_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS retained FROM h WINDOW w AS (PARTITION BY text_hash)",
    "exact_duplicate_groups": f"SELECT text_hash, doc_id, members FROM (SELECT *, count(*) OVER (PARTITION BY text_hash) AS members FROM ({_HASHES})) WHERE members > 1",
    "exact_duplicate_report": f"WITH h AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS base FROM ({_HASHES})), r AS (SELECT *, first_value(doc_id) OVER w AS keep, first_value(base) OVER w AS won FROM h WINDOW w AS (PARTITION BY text_hash ORDER BY base DESC, doc_id)) "
    "SELECT text_hash, keep AS retained_id, doc_id AS rejected_id, won AS retained_is_base, CASE WHEN won THEN 'exact_normalized_text_match_base_preferred' ELSE 'exact_normalized_text_match_first_seen_preferred' END AS reason FROM r WHERE keep <> doc_id",
    "duplicate_keys": " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS groups, sum(n)::BIGINT AS documents, max(n) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY {e} HAVING count(*) > 1) HAVING count(*) > 0" for k, e in _KINDS.items()),
    "ocr_signal_counts": f"SELECT doc_id, {_SIGNALS} FROM documents",
    "ocr_document_rates": f"WITH c AS (SELECT doc_id, {_SIGNALS} FROM documents), u AS (UNPIVOT c ON COLUMNS(* EXCLUDE doc_id) INTO NAME signal VALUE hits) SELECT signal, count(*) FILTER (hits > 0) AS documents, sum(hits)::BIGINT AS hits, round(count(*) FILTER (hits > 0) / count(*), 9) AS rate FROM u GROUP BY signal",
    "line_repetition": f"SELECT doc_id, len(l)::BIGINT AS lines, len(list_distinct(l))::BIGINT AS distinct_lines, (len(l) - len(list_distinct(l)))::BIGINT AS repeated FROM (SELECT doc_id, {X.SQL_LINES} AS l FROM documents)",
}
