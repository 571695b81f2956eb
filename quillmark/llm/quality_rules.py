"""Quality rules: a threshold table compiled into one projection.

All figures are built-in expressions over the text; no user function runs.  A row's words
are split once and kept as a column; three-word windows are compared as 64-bit hashes
inside the row (a text of n words has about n^2 / 2^65 chance of a false match), with one
sort for texts that have a repeated window and none for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, free_name, table

#: (name, figure, lowest, highest): a text passes if every figure lies within its bounds.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.1),
    ("shout_ratio", "n_shouts / n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 0.06, None),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
)

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as be by for from in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "con del el es las los no para por se su y"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def with_figures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the figures as new columns; the dict maps a figure to its column's name."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = {k: free_name(docs, f"q_{k}") for k in (
        "words", "lines", "windows", "sorted", "hits", "n_words", "word_chars", "n_symbols", "n_shouts",
        "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words",
    )}
    c = {k: F.col(v) for k, v in n.items()}
    df = docs.withColumn(n["words"], F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)))
    df = df.withColumn(n["lines"], F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(WORD)))
    windows = F.transform(
        F.sequence(F.lit(0), F.size(c["words"]) - 3),
        lambda i: F.xxhash64(F.get(c["words"], i), F.get(c["words"], i + 1), F.get(c["words"], i + 2)),
    )
    df = df.withColumn(n["windows"], F.when(F.size(c["words"]) >= 3, windows))
    # Window hashes beside their places, sorted, only where some hash repeats.
    pairs = F.transform(c["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(n["sorted"], F.when(F.size(F.array_distinct(c["windows"])) < F.size(c["windows"]), F.sort_array(pairs)))
    twice = F.filter(
        c["sorted"],
        lambda x, j: x["h"].eqNullSafe(F.get(c["sorted"], j - 1)["h"]) | x["h"].eqNullSafe(F.get(c["sorted"], j + 1)["h"]),
    )
    df = df.withColumn(n["hits"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    # A window covers the words up to the next one, three at most.
    gaps = F.transform(c["hits"], lambda x, k: F.least(F.lit(3), F.coalesce(F.get(c["hits"], k + 1) - x, F.lit(3))))
    count = lambda pattern: F.regexp_count(raw, F.lit(pattern)).cast("long")
    lines_with = lambda pattern: F.size(F.filter(c["lines"], lambda x: x.rlike(pattern))).cast("long")
    stop_word = lambda w: F.lower(F.rtrim(w, F.lit(",.;:!?"))).isin(*sorted(STOP_WORDS))
    figures = {
        "n_words": F.size(c["words"]).cast("long"),
        "word_chars": F.length(F.array_join(c["words"], "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_shouts": count("!!"),
        "n_stop_words": F.size(F.filter(c["words"], stop_word)).cast("long"),
        "n_lines": F.size(c["lines"]).cast("long"),
        "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        "n_bullet_lines": lines_with(r"^[\x20\t]*[-*•‣◦·]"),
        "n_ellipsis_lines": lines_with(r"(?:…|\.\.\.)[\x20\t]*$"),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }
    df = df.withColumns({n[k]: v for k, v in figures.items()})
    return df.drop(*(n[k] for k in ("words", "lines", "windows", "sorted", "hits"))), {k: n[k] for k in figures}


def verdict(names: dict[str, str], thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(base_failed, kept) over the figures' columns; ratios over nothing pass."""
    words, repeat = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    base_failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    passed = F.lit(True)
    for _, figure, low, high in thresholds:
        over, under = (F.col(names[x.strip()]) for x in figure.split("/"))
        ratio = over / F.when(under > 0, under)
        if low is not None:
            passed = passed & F.coalesce(ratio >= low, F.lit(True))
        if high is not None:
            passed = passed & F.coalesce(ratio <= high, F.lit(True))
    # The optimiser would push a filter on a deterministic verdict below the projections and
    # copy their expressions into it again and again; this always true term keeps it above.
    computed_once = F.monotonically_increasing_id() >= 0
    return base_failed, ~base_failed & passed & computed_once


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per row of ``docs``: the id, all figures, base_failed and kept.

    Null text counts as empty: no words, so base_failed.  Repeated rows are judged each
    for itself; other columns are ignored and may have any name; an empty table gives no rows.
    """
    df, names = with_figures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    base_failed, kept = verdict(names, thresholds)
    return df.select("id", *(F.col(v).alias(k) for k, v in names.items()), base_failed.alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    df, names = with_figures(docs, text_col)
    kept = free_name(docs, "q_kept")
    return df.withColumn(kept, verdict(names, thresholds)[1]).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_figures(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!!'))::BIGINT AS n_shouts,
         len(list_filter(w, lambda x: lower(rtrim(x, ',.;:!?')) IN ({", ".join(f"'{x}'" for x in sorted(STOP_WORDS))})))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t]*[-*•‣◦·]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\t]*$')))::BIGINT AS n_ellipsis_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {" AND ".join(
    f"coalesce({a.strip()} / nullif({u.strip()}, 0) {op} {v}, TRUE)"
    for _, fig, lo, hi in THRESHOLDS for a, u in [fig.split("/")] for op, v in ((">=", lo), ("<=", hi)) if v is not None
)} AS kept
FROM b
"""
