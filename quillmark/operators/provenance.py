"""Evidence rules of the third corpus generation, gates, and per-source reports.

Rules are predicates over a record's columns; the first that fails names the rejection.
Documents carry no evidence, so the registered queries derive it from digits of a hash of
the id: every rule meets records that pass and that fail it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as X
from ..plans.scratch import weighted_join, written
from ..sources.tables import table
from .admission import title_of

# Allowed rights, and the last day that evidence may bear.
ALLOWED_RIGHTS = ("public_domain", "public_domain_us", "cc0", "cc_by")
CUTOFF = "2026-10-12"
BOILERPLATE = r"(?i)project gutenberg|end of (?:the )?project gutenberg"
REASONS = (
    "invalid_schema", "rights_status_not_allowed", "incomplete_rights_evidence", "invalid_source_hash", "incomplete_creator_evidence",
    "incomplete_genre_evidence", "incomplete_publication_year_evidence", "unverified_story_boundary", "story_length_out_of_range",
    "prohibited_text_signal", "quality_review_required",
)
GENRES = tuple(C.BROAD_GENRES)


def nonblank(c: Column) -> Column:
    return F.coalesce(X.strip(c) != "", F.lit(False))


def valid_date(value: Column, cutoff: str = CUTOFF) -> Column:
    """An ISO date or time, Z allowed, whose day is not after the cutoff."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    return F.coalesce(shape & (day <= F.lit(cutoff).cast("date")), F.lit(False))


def valid_schema(fields: tuple[str, ...] = ("id", "source", "source_url", "title", "collection_id", "source_sha256")) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & nonblank(F.col(f))
    return out


def valid_rights(cutoff: str = CUTOFF) -> Column:
    e = F.col("rights_evidence")
    return F.coalesce(F.col("rights_status").isin(*ALLOWED_RIGHTS), F.lit(False)) & nonblank(e["basis"]) & nonblank(e["evidence_url"]) & nonblank(e["checked_by"]) & valid_date(e["checked_at"], cutoff)


def valid_creator() -> Column:
    e = F.col("creator_evidence")
    return nonblank(F.col("primary_author")) & F.coalesce(F.col("creator_id") != "unknown", F.lit(True)) & nonblank(e["method"]) & nonblank(e["primary_role"])


def valid_genres(cutoff: str = CUTOFF) -> Column:
    """Known labels; explicitly unclassified exactly if there is none; each label supported by
    a term in a source value or by a reviewed mapping."""
    e, g = F.col("genre_evidence"), F.col("genres")
    values = F.transform(e["source_values"], F.lower)
    reviewed = nonblank(e["reviewed_by"]) & valid_date(e["reviewed_at"], cutoff)

    def supported(label):
        by_term = F.lit(False)
        for name, terms in C.BROAD_GENRES.items():
            by_term = by_term | ((label == name) & F.exists(values, lambda v: C._any_term(v, terms)))  # noqa: B023
        return by_term | (reviewed & F.coalesce(F.array_contains(e["reviewed_mappings"], label), F.lit(False)))

    known = F.forall(g, lambda x: x.isin(*GENRES))
    stated = F.coalesce(e["explicitly_unclassified"] == (F.size(g) == 0), F.lit(False))
    some = F.coalesce(F.size(e["source_values"]) > 0, F.lit(False)) & F.coalesce(F.forall(g, supported), F.lit(False))
    return g.isNotNull() & F.coalesce(known, F.lit(False)) & nonblank(e["method"]) & stated & ((F.size(g) == 0) | some)


def valid_year() -> Column:
    e, year = F.col("publication_year_evidence"), F.col("publication_year")
    return F.coalesce(((e["status"] == "unknown") & year.isNull()) | ((e["status"] == "known") & year.isNotNull() & nonblank(e["source"])), F.lit(False))


def valid_boundary() -> Column:
    e = F.col("boundary_evidence")
    return F.coalesce(e["confidence"] == "high", F.lit(False)) & nonblank(e["method"])


def rejection(minimum: int, maximum: int, quarantine: tuple[str, ...], cutoff: str = CUTOFF) -> Column:
    """First failing rule of a record (null: none).

    Columns beside those of the rules: words, n_replacement, boilerplate and, for each
    quarantine signal, its count.
    """
    signals = F.lit(False)
    for s in quarantine:
        signals = signals | (F.col(s) > 0)
    rules = (
        ~valid_schema(), ~F.coalesce(F.col("rights_status").isin(*ALLOWED_RIGHTS), F.lit(False)), ~valid_rights(cutoff), ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        ~valid_creator(), ~valid_genres(cutoff), ~valid_year(), ~valid_boundary(), F.coalesce(~F.col("words").between(minimum, maximum), F.lit(True)),
        (F.col("replacement_character") > 0) | F.col("boilerplate"), signals,
    )
    out = None
    for reason, broken in zip(REASONS, rules, strict=True):
        out = F.when(broken, reason) if out is None else out.when(broken, reason)
    return out


#: How the queries derive evidence: digit n of the hash of the id, 0 to 15.
_digit = lambda n: F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), n, 1), 16, 10).cast("int")


def evidenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of generation 3, with derived evidence, written once."""
    text, d = X.body(F.col("text")), _digit
    genre = lambda n: F.element_at(F.array(*map(F.lit, GENRES)), d(n) % 8 + 1)
    signals = {n: F.regexp_count(text, F.lit(p)) for n, p in X.OCR_PATTERNS if n in ("replacement_character", "suspicious_markup_glyph", "digit_intrusion")}
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), "source", F.col("source").alias("collection_id"), F.when(d(1) > 0, "https://example.org/x").otherwise(" ").alias("source_url"), title_of(F.col("text")).alias("title"),
        F.when(d(2) > 0, F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256)).otherwise("none").alias("source_sha256"), F.element_at(F.array(*map(F.lit, (*ALLOWED_RIGHTS, "unknown"))), d(3) % 5 + 1).alias("rights_status"),
        F.struct(F.when(d(4) > 0, "stated").alias("basis"), F.lit("https://example.org/r").alias("evidence_url"), F.element_at(F.array(F.lit("2026-01-02"), F.lit("2026-10-12T23:59:00Z"), F.lit("2027-01-01"), F.lit("soon")), F.least(d(5), F.lit(3)) + 1).alias("checked_at"), F.lit("me").alias("checked_by")).alias("rights_evidence"),
        F.when(d(6) > 0, "A. Author").alias("primary_author"), F.when(d(7) > 0, "a").otherwise("unknown").alias("creator_id"), F.struct(F.lit("catalog").alias("method"), F.lit("author").alias("primary_role")).alias("creator_evidence"),
        F.when(d(8) < 2, F.array().cast("array<string>")).when(d(8) == 2, F.array(F.lit("noir"))).otherwise(F.array(genre(9))).alias("genres"),
        F.struct(F.lit("mapping").alias("method"), F.array(F.element_at(F.array(*(F.lit(t[0].upper()) for t in C.BROAD_GENRES.values())), F.when(d(10) < 3, d(11) % 8).otherwise(d(9) % 8) + 1)).alias("source_values"), (d(8) < 1).alias("explicitly_unclassified"),
                 F.when(d(12) < 8, F.array(genre(9))).alias("reviewed_mappings"), F.lit("you").alias("reviewed_by"), F.lit("2026-05-05").alias("reviewed_at")).alias("genre_evidence"),
        F.when(d(13) > 7, F.lit(1900) + d(13)).alias("publication_year"), F.struct(F.when(d(13) > 6, "known").otherwise("unknown").alias("status"), F.when(d(14) > 0, "title page").alias("source")).alias("publication_year_evidence"),
        F.struct(F.when(d(15) > 0, "high").otherwise("medium").alias("confidence"), F.lit("heading").alias("method")).alias("boundary_evidence"),
        F.size(X.split_words(F.col("text"))).alias("words"), F.regexp_like(text, F.lit(BOILERPLATE)).alias("boilerplate"), *(c.alias(n) for n, c in signals.items()),
        X.text_hash(F.col("text")).alias("text_hash"),
    )
    return written(rows, "evidence")


def judged(records: DataFrame) -> DataFrame:
    """+ reason; of records that pass every rule the first of a normalised text stays, the rest are exact duplicates."""
    r = written(records.withColumn("reason", rejection(20, 20_000, ("suspicious_markup_glyph", "digit_intrusion"))).select("doc_id", "source", "words", "text_hash", "genres", "reason"), "judged")
    passed = r.where("reason IS NULL")
    first = passed.groupBy("text_hash").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))
    passed = weighted_join(passed, first, "text_hash", "n", r.count()).withColumn("reason", F.when(F.col("doc_id") != F.col("winner"), "exact_normalized_duplicate"))
    return r.where("reason IS NOT NULL").union(passed.select(r.columns))


def evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(evidenced(spark, sf_dir)).select("doc_id", "reason")


def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gate, passed, records): for each rule the records that pass it; a rule passes if all do and there are any."""
    e = evidenced(spark, sf_dir)
    rules = {"schema": valid_schema(), "rights_evidence": valid_rights(), "source_hashes": F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "creator": valid_creator(), "genres": valid_genres(), "year": valid_year(), "story_boundaries": valid_boundary()}
    counts = e.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    long = counts.unpivot("n", list(rules), "gate", "records")
    return long.select("gate", ((F.col("n") > 0) & (F.col("n") == F.col("records"))).alias("passed"), "records")


def failed_gates(gates: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Required gates that failed or are missing: (gate)."""
    spark = gates.sparkSession
    wanted = spark.createDataFrame([(g,) for g in required], "gate string")
    return wanted.join(gates, "gate", "left").where(~F.coalesce("passed", F.lit(False))).select("gate")


def failed_required_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_gates(evidence_gates(spark, sf_dir), ("schema", "rights_evidence", "source_hashes", "creator", "genres", "year", "story_boundaries", "near_duplicates"))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: gross and duplicate-adjusted records and words, accepted, and the commonest reason."""
    j = judged(evidenced(spark, sf_dir))
    lost = F.col("reason") == "exact_normalized_duplicate"
    per = j.groupBy("source").agg(
        F.count("*").alias("gross"), F.sum("words").cast("long").alias("gross_words"), F.count_if(lost).alias("duplicates"), F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("words"))), F.lit(0)).cast("long").alias("accepted_words"),
    )
    reasons = j.where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("c"))
    top = reasons.groupBy("source").agg(F.max_by("reason", F.struct("c", "reason")).alias("commonest_reason"))
    return per.join(top, per["source"].eqNullSafe(top["source"]), "left").select(per["source"], "gross", "gross_words", (F.col("gross") - F.col("duplicates")).alias("adjusted"), "accepted", "accepted_words", "commonest_reason")


def rejection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections whose reason holds a term, for each of three terms."""
    j = judged(evidenced(spark, sf_dir)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("c"))
    terms = ("evidence", "duplicate", "quality")
    return j.agg(*(F.coalesce(F.sum(F.when(F.contains("reason", F.lit(t)), F.col("c"))), F.lit(0)).alias(t) for t in terms)).unpivot([], list(terms), "term", "records")


def genre_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and words by genre, every label in full, none as unclassified, with the share of all words."""
    j = evidenced(spark, sf_dir).select("words", F.explode(F.when(F.size("genres") > 0, F.col("genres")).otherwise(F.array(F.lit("unclassified")))).alias("genre"))
    total = evidenced(spark, sf_dir).agg(F.sum("words").alias("all"))
    g = j.groupBy("genre").agg(F.count("*").alias("records"), F.sum("words").cast("long").alias("words"))
    return g.crossJoin(F.broadcast(total)).select("genre", "records", "words", F.round(F.col("words") / F.greatest(F.lit(1), "all"), 9).alias("word_share"))


def review_exclusions(decisions: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Ids of valid exclusion decisions (id, decision, reviewer, reviewed_at, rationale); an
    invalid or repeated one fails the job."""
    ok = nonblank(F.col("id")) & (F.col("decision") == "exclude") & nonblank(F.col("reviewer")) & valid_date(F.col("reviewed_at"), cutoff) & nonblank(F.col("rationale"))
    checked = decisions.select(F.when(F.coalesce(ok, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.lit("an exclusion lacks an id, a decision, a reviewer, a date or a rationale")).cast("string")).alias("id"))
    once = checked.groupBy("id").agg(F.count("*").alias("n"))
    return once.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("excluded twice: "), F.col("id"))).cast("string")).alias("id"))


QUERIES = {
    "evidence_decisions": evidence_decisions, "evidence_gates": evidence_gates, "failed_required_gates": failed_required_gates,
    "source_report": source_report, "rejection_totals": rejection_totals, "genre_tokens": genre_tokens,
}

_D = lambda n: f"('0x' || substr(sha256(doc_id::VARCHAR), {n}, 1))::INT"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_T = "coalesce(text, '')"
_SIG = {n: p for n, p in X.OCR_PATTERNS}
_DATE = f"{_LIST(['2026-01-02', '2026-10-12T23:59:00Z', '2027-01-01', 'soon'])}[least({_D(5)}, 3) + 1] IN ('2026-01-02', '2026-10-12T23:59:00Z')"
_SUPPORT = " OR ".join(f"(genre = '{g}' AND ({C._sql_any('lower(sv)', t)}))" for g, t in C.BROAD_GENRES.items())
_EVID = f"""WITH e0 AS (SELECT doc_id, source, text, {_LIST(GENRES)}[{_D(9)} % 8 + 1] AS genre, {_LIST([t[0].upper() for t in C.BROAD_GENRES.values()])}[CASE WHEN {_D(10)} < 3 THEN {_D(11)} % 8 ELSE {_D(9)} % 8 END + 1] AS sv, len({X.sql_split_words(_T)}) AS words FROM documents),
 e AS (SELECT *, {X.SQL_HASH} AS h, CASE WHEN {_D(8)} < 2 THEN [] WHEN {_D(8)} = 2 THEN ['noir'] ELSE [genre] END AS genres,
  {_D(1)} > 0 AND {X.sql_strip("coalesce(source, '')")} <> '' AND {X.sql_strip(f"split_part({_T}, chr(10), 1)")} <> '' AS ok_schema, {_D(3)} % 5 < 4 AS ok_status, {_D(3)} % 5 < 4 AND {_D(4)} > 0 AND {_DATE} AS ok_rights, {_D(2)} > 0 AS ok_hash,
  {_D(6)} > 0 AND {_D(7)} > 0 AS ok_creator, CASE WHEN {_D(8)} = 0 THEN TRUE WHEN {_D(8)} <= 2 THEN FALSE ELSE ({_SUPPORT}) OR {_D(12)} < 8 END AS ok_genre, CASE WHEN {_D(13)} > 7 THEN {_D(14)} > 0 WHEN {_D(13)} = 7 THEN FALSE ELSE TRUE END AS ok_year, {_D(15)} > 0 AS ok_boundary FROM e0),
 r AS (SELECT *, CASE WHEN NOT ok_schema THEN 'invalid_schema' WHEN NOT ok_status THEN 'rights_status_not_allowed' WHEN NOT ok_rights THEN 'incomplete_rights_evidence' WHEN NOT ok_hash THEN 'invalid_source_hash' WHEN NOT ok_creator THEN 'incomplete_creator_evidence'
  WHEN NOT ok_genre THEN 'incomplete_genre_evidence' WHEN NOT ok_year THEN 'incomplete_publication_year_evidence' WHEN NOT ok_boundary THEN 'unverified_story_boundary' WHEN words NOT BETWEEN 20 AND 20000 THEN 'story_length_out_of_range'
  WHEN contains({_T}, chr(65533)) OR regexp_matches({_T}, '{BOILERPLATE}') THEN 'prohibited_text_signal' WHEN regexp_matches({_T}, '{_SIG["suspicious_markup_glyph"]}') OR regexp_matches({_T}, '{_SIG["digit_intrusion"]}') THEN 'quality_review_required' END AS rule FROM e),
 w AS (SELECT h, min(doc_id) AS winner FROM r WHERE rule IS NULL GROUP BY h), j AS (SELECT r.*, coalesce(rule, CASE WHEN doc_id <> winner THEN 'exact_normalized_duplicate' END) AS reason FROM r LEFT JOIN w USING (h))"""
_GATES = {"schema": "ok_schema", "rights_evidence": "ok_rights", "source_hashes": "ok_hash", "creator": "ok_creator", "genres": "ok_genre", "year": "ok_year", "story_boundaries": "ok_boundary"}
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS gate, count(*) > 0 AND count(*) = count(*) FILTER ({c}) AS passed, count(*) FILTER ({c}) AS records FROM e" for k, c in _GATES.items())
ORACLE_SQL = {
    "evidence_decisions": f"{_EVID} SELECT doc_id, reason FROM j",
    "evidence_gates": f"{_EVID} {_GATE_ROWS}",
    "failed_required_gates": f"{_EVID}, g AS ({_GATE_ROWS}) SELECT gate FROM (SELECT unnest({_LIST([*_GATES, 'near_duplicates'])}) AS gate) LEFT JOIN g USING (gate) WHERE NOT coalesce(passed, FALSE)",
    "source_report": f"{_EVID}, c AS (SELECT source, reason, count(*) AS c FROM j WHERE reason IS NOT NULL GROUP BY ALL), t AS (SELECT source, arg_max(reason, (c, reason)) AS commonest_reason FROM c GROUP BY source) "
    "SELECT p.*, commonest_reason FROM (SELECT source, count(*) AS gross, sum(words)::BIGINT AS gross_words, count(*) FILTER (reason IS NULL OR reason <> 'exact_normalized_duplicate') AS adjusted, count(*) FILTER (reason IS NULL) AS accepted, coalesce(sum(words) FILTER (reason IS NULL), 0)::BIGINT AS accepted_words FROM j GROUP BY source) p LEFT JOIN t ON p.source IS NOT DISTINCT FROM t.source",
    "rejection_totals": f"{_EVID} " + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (contains(reason, '{t}')) AS records FROM j" for t in ("evidence", "duplicate", "quality")),
    "genre_tokens": f"{_EVID}, x AS (SELECT unnest(CASE WHEN len(genres) > 0 THEN genres ELSE ['unclassified'] END) AS genre, words FROM e) SELECT genre, count(*) AS records, sum(words)::BIGINT AS words, round(sum(words) / greatest(1, (SELECT sum(words) FROM e)), 9) AS word_share FROM x GROUP BY genre",
}
