"""Canonical records: cleaning, labels, names, identities, catalog rules and record preparation.

The operators take columns or DataFrames of any origin; the registered queries feed them
from the given tables, whose columns stand in for the missing metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as X
from ..plans.scratch import weighted_join, written
from ..sources.tables import table
from .admission import _HEADING, heading, title_of

_START, _END = "*** START OF THE PROJECT GUTENBERG EBOOK A BOOK ***", "*** END OF THIS PROJECT GUTENBERG EBOOK A BOOK ***"
#: Stand-ins for catalog subjects, by document number.
SUBJECTS = (
    "Detective and mystery stories", "Ghost stories; Short stories", "Science fiction; Interplanetary voyages", "Western stories -- Frontier life",
    "Sea stories", "Folklore; Fairy tale", "Essays", "Weird fiction", "Love stories", "English poetry; Short stories", "Survival; Short stories",
)
_subject = lambda key: F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.pmod(key, F.lit(len(SUBJECTS))) + 1).cast("int"))
_SUBJECT = lambda key: f"[{', '.join(repr(s) for s in SUBJECTS)}][{key} % {len(SUBJECTS)} + 1]"


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text after each cleaning; the wrapped ones get markers and carriage returns first."""
    text = X.body(F.col("text"))
    wrapped = F.concat(F.lit(f"Title \r\n{_START}\r\n \r\n\r\n\r\n"), F.replace(text, F.lit("\n"), F.lit(" \r\n")), F.lit(f"\r\n{_END} 1\r\nlicense"))
    marked = F.concat(F.lit("Produced by  someone.\n\n"), F.replace(text, F.lit("\n"), F.lit("\n\n")), F.lit("\n\nPAGE I. one II. two III. three"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", _sha(C.clean_story(F.concat(F.lit("\r\n \x00"), text))).alias("story"), _sha(C.drop_boilerplate(marked)).alias("no_boilerplate"),
        _sha(C.clean_wrapped(wrapped)).alias("wrapped"), _sha(C.clean_book(wrapped)).alias("book"),
    )


def genre_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = _subject(F.col("doc_id"))
    broad = C.broad_genres(F.split(subject, "; "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(C.title_genres(subject), ",").alias("title_genres"), F.array_join(broad, ",").alias("broad_genres"), C.control_token(broad).alias("control_token")
    )


def _creator_value() -> Column:
    k, name = F.col("c_custkey"), F.col("c_name")
    years = lambda a, b: F.concat(F.lit(", "), (k % 100 + a).cast("string"), F.lit("-"), b)
    return (
        F.when(k % 5 == 0, F.concat(name, years(1800, (k % 90 + 1880).cast("string"))))
        .when(k % 5 == 1, F.concat(name, years(1800, F.lit("")), F.lit(" [Editor]; "), F.col("c_mktsegment"), F.lit(" [Author]")))
        .when(k % 5 == 2, F.concat(F.lit(" "), name, F.lit(" [author] ;; "), F.col("c_mktsegment")))
        .when(k % 5 == 3, F.lit("Anonymous")).otherwise(F.concat(name, F.lit(", ca. 1850-1910")))
    )


_CREATOR = """CASE c_custkey % 5 WHEN 0 THEN c_name || ', ' || (c_custkey % 100 + 1800) || '-' || (c_custkey % 90 + 1880) WHEN 1 THEN c_name || ', ' || (c_custkey % 100 + 1800) || '-' || ' [Editor]; ' || c_mktsegment || ' [Author]'
  WHEN 2 THEN ' ' || c_name || ' [author] ;; ' || c_mktsegment WHEN 3 THEN 'Anonymous' ELSE c_name || ', ca. 1850-1910' END"""


def creator_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creators, the primary one, its normalised name, a collection key and the public-domain rule of every customer."""
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", _creator_value().alias("value"))
    d = d.withColumn("found", C.creators(F.col("value"))).withColumn("first", C.primary_creator(F.col("found")))
    key = C.collection_key(F.when(F.col("c_custkey") % 2 == 0, "project_gutenberg").otherwise("seed"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("pg-"), F.col("c_custkey").cast("string"))), F.col("c_mktsegment"))
    return d.select(
        "c_custkey", F.size("found").cast("long").alias("creators"), "first.name", "first.role", "first.author", C.normalized_name(F.col("first.name")).alias("normalized"),
        key.alias("collection_key"), C.safely_public(F.col("value")).alias("safely_public"),
    )


def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised heading of each document's first line, whether it is structural, and the opening's digest."""
    from .admission import NON_STORY_TITLE, STRUCTURAL_TITLE

    h = heading(title_of(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", h.alias("heading"), h.rlike(STRUCTURAL_TITLE).alias("structural"), h.rlike(NON_STORY_TITLE).alias("not_a_story"),
        _sha(F.array_join(F.slice(X.words(F.col("text")), 1, 40), " ")).alias("opening"),
    )


def story_records(docs: DataFrame) -> DataFrame:
    """Canonical records: stable id of source, heading and text; genres, group and counts."""
    text = F.col("text")
    text_hash = _sha(X.body(text))
    book = F.col("doc_id").cast("string")
    stable = F.substring(_sha(F.concat_ws("\x00", book, heading(title_of(text)), text_hash)), 1, 12)
    subjects = F.filter(F.transform(F.split(_subject(F.col("doc_id")), ";"), X.strip), lambda x: (x != "") & (F.length(x) <= 100))
    return docs.select(
        "doc_id", F.concat(F.lit("pg-"), book, F.lit("-"), stable).alias("id"), F.concat(F.lit("pg-"), book).alias("source_id"), F.col("source").alias("source_collection"),
        title_of(text).alias("title"), text_hash.alias("text_hash"), F.size(X.split_words(text)).cast("long").alias("words"),
        F.array_join(subjects, "|").alias("source_genres"), F.array_join(C.broad_genres(subjects), "|").alias("broad_genres"),
        F.concat(F.lit("https://example.org/"), book, F.lit(".txt")).alias("source_url"),
    )


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_records(table(spark, sf_dir, "documents")).drop("doc_id")


def record_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in both JSON dialects, a seed and review ids of every document's metadata."""
    fields = {"source": (F.col("source"), "string"), "doc_id": (F.col("doc_id"), "long"), "lang": (F.col("lang"), "string"), "genres": (F.array("lang", "source"), "array<string>"), "none": (F.lit(None).cast("string"), "string")}
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.record_hash(fields).alias("canonical_sha256"), _sha(C.json_line(fields)).alias("line_sha256"),
        C.stable_seed(1337, (F.col("source"), "string"), (F.col("doc_id"), "long")).alias("seed"),
        C.short_id("review-", 20, (F.col("doc_id").cast("string"), "string"), (_sha(X.body(F.col("text"))), "string"), (F.col("lang"), "string")).alias("review_id"),
        C.short_id("owner-review-", 24, (F.lit(260209), "int"), (F.col("doc_id").cast("string"), "string")).alias("owner_review_id"),
        _sha(F.array_join(X.words(F.col("text")), " ")).alias("normalized_sha256"),
    )


def file_fingerprint(rows: DataFrame, line: str, order: str) -> DataFrame:
    """(sha256, lines): one digest of all lines in order.

    Lines are digested one by one and their digests combined in order, block by block, so
    no task holds all lines; ``order`` is a unique long.
    """
    d = rows.select(F.col(order).alias("k"), F.sha2(F.col(line).cast("binary"), 256).alias("h"), F.expr(f"{order} div 4096").alias("block"))
    blocks = d.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("m"), F.count("*").alias("lines"))
    blocks = blocks.select("block", F.sha2(F.array_join(F.transform("m", lambda x: x["h"]), "").cast("binary"), 256).alias("h"), "lines")
    out = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "h"))).alias("m"), F.sum("lines").alias("lines"))
    return out.select(F.sha2(F.array_join(F.transform("m", lambda x: x["h"]), "").cast("binary"), 256).alias("sha256"), "lines")


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_fingerprint(table(spark, sf_dir, "documents").select("doc_id", X.body(F.col("text")).alias("line")), "line", "doc_id")


def prepared(docs: DataFrame, unclassified: bool = False) -> DataFrame:
    """(doc_id, outcome, canonical_id): invalid_record, duplicate_text, unclassified_book or accepted.

    The first of equal cleaned texts, by id, is canonical; a text without a genre counts
    as unclassified unless ``unclassified`` lets it in.
    """
    text = C.clean_story(F.col("text"))
    d = docs.select("doc_id", _sha(text).alias("text_hash"), (F.size(X.split_words(text)) == 0).alias("invalid"), (F.size(C.title_genres(_subject(F.col("doc_id")))) == 0).alias("plain"))
    d = written(d, "cleaned")
    keep = d.where(~F.col("invalid") & (~F.col("plain") | F.lit(unclassified)))
    first = keep.groupBy("text_hash").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n"))
    out = weighted_join(d, first, "text_hash", "n", d.count(), "left")
    # A record without a genre is a duplicate only of an accepted one before it.
    again = ~F.col("invalid") & (F.col("canonical_id") < F.col("doc_id"))
    outcome = F.when(F.col("invalid"), "invalid_record").when(again, "duplicate_text").when(F.col("plain") & ~F.lit(unclassified), "unclassified_book").otherwise("accepted")
    return out.select("doc_id", outcome.alias("outcome"), F.when(again, F.col("canonical_id")).alias("canonical_id"))


def prepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(table(spark, sf_dir, "documents"))


def preparation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_records(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("records"))


def catalog_candidates(catalog: DataFrame) -> DataFrame:
    """Rows of a catalog that may hold short stories, with their place in the order of work.

    Columns: number, type, language, title, authors, subjects, bookshelves.  Order: titles
    or subjects with a target term first, then by number.
    """
    searchable, title = F.lower(F.concat_ws(" ", "subjects", "bookshelves")), F.lower("title")
    keep = (
        (F.col("type") == "Text") & (F.col("language") == "en") & (searchable.contains("short stories") | title.contains("short stories"))
        & ~searchable.rlike(r"\b(?:essays?|poetry|poems?)\b") & C.safely_public(F.col("authors"))
    )
    terms = r"(?i)detective|mystery|ghost|horror|science fiction|western|adventure|fantasy|weird|sea stor|short stor|tales|fables"
    return catalog.where(keep).select("number", "title", (~F.concat_ws(" ", "title", "subjects").rlike(terms)).cast("int").alias("later"))


def catalog_candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return catalog_candidates(p.select(
        k.alias("number"), F.when(k % 7 == 0, "Sound").otherwise("Text").alias("type"), F.when(k % 5 == 0, "fr").otherwise("en").alias("language"), F.col("p_name").alias("title"),
        F.when(k % 4 == 0, "Unknown").when(k % 4 == 1, F.concat(F.lit("A, 18"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-1960"))).otherwise("B, 1820-1901").alias("authors"),
        _subject(k).alias("subjects"), F.lit("").alias("bookshelves"),
    ))


QUERIES = {
    "cleaned_texts": cleaned_texts, "genre_labels": genre_labels, "creator_names": creator_names, "heading_counts": heading_counts,
    "canonical_records": canonical_records, "record_identities": record_identities, "corpus_fingerprint": corpus_fingerprint,
    "prepared_records": prepared_records, "preparation_counters": preparation_counters, "catalog_candidate_rows": catalog_candidate_rows,
}

_T = "coalesce(text, '')"
_CR = "chr(13) || chr(10)"
_WRAPPED = f"'Title ' || {_CR} || '{_START}' || {_CR} || ' ' || {_CR} || {_CR} || {_CR} || replace({_T}, chr(10), ' ' || {_CR}) || {_CR} || '{_END} 1' || {_CR} || 'license'"
_MARKED = f"'Produced by  someone.' || chr(10) || chr(10) || replace({_T}, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'PAGE I. one II. two III. three'"
_HEAD = _HEADING.replace("title,", f"split_part({_T}, chr(10), 1),")
from .admission import NON_STORY_TITLE as _NON, STRUCTURAL_TITLE as _STRUCT  # noqa: E402

_GENRES = f"list_filter(list_transform(string_split({_SUBJECT('doc_id')}, ';'), lambda s: trim(s)), lambda s: s <> '' AND len(s) <= 100)"
_PARTS = "list_filter(list_transform(string_split(value, ';'), lambda p: trim(p)), lambda p: p <> '')"
_ROLE = r"\s*\[([^\]]+)\]\s*$"
_NAME = r"lower(first_name)"
_PREPARED = f"""WITH d AS (SELECT doc_id, sha256({X.sql_strip(C.sql_unix(_T))}) AS h, {X.sql_strip(_T)} = '' AS invalid, len({C.sql_title_genres(_SUBJECT('doc_id'))}) = 0 AS plain FROM documents),
  f AS (SELECT h, min(doc_id) AS first FROM d WHERE NOT invalid AND NOT plain GROUP BY h)
  SELECT doc_id, CASE WHEN invalid THEN 'invalid_record' WHEN first < doc_id THEN 'duplicate_text' WHEN plain THEN 'unclassified_book' ELSE 'accepted' END AS outcome,
    CASE WHEN NOT invalid AND first < doc_id THEN first END AS canonical_id FROM d LEFT JOIN f USING (h)"""
_PUBLIC = lambda a: (
    f"CASE WHEN trim({a}) = '' THEN TRUE WHEN regexp_matches({a}, '(^|[^0-9])(1[0-9]{{3}}|20[0-9]{{2}})\\??-\\s*(;|$)') THEN FALSE "
    f"WHEN len(regexp_extract_all({a}, '[0-9]+')) = 0 OR len(list_filter(regexp_extract_all({a}, '[0-9]+'), lambda y: regexp_full_match(y, '1[0-9]{{3}}|20[0-9]{{2}}'))) = 0 "
    f"THEN contains(lower({a}), 'anonymous') OR contains(lower({a}), 'unknown') "
    f"ELSE list_max(list_transform(list_filter(regexp_extract_all({a}, '[0-9]+'), lambda y: regexp_full_match(y, '1[0-9]{{3}}|20[0-9]{{2}}')), lambda y: y::INT)) <= 1955 END"
)
_JSON = """'{"doc_id":' || doc_id || ',"genres":["' || lang || '","' || source || '"],"lang":"' || lang || '","none":null,"source":"' || source || '"}'"""
_LINE = """'{"source": "' || source || '", "doc_id": ' || doc_id || ', "lang": "' || lang || '", "genres": ["' || lang || '", "' || source || '"], "none": null}' || chr(10)"""
ORACLE_SQL = {
    "cleaned_texts": f"SELECT doc_id, sha256({X.sql_strip(C.sql_unix(f'{_CR} || chr(32) || chr(0) || {_T}'))}) AS story, sha256({C.sql_drop_boilerplate(_MARKED)}) AS no_boilerplate, sha256({X.sql_strip(C.sql_rstripped(_WRAPPED))}) AS wrapped, "
    + rf"sha256({X.sql_strip(f'''regexp_replace({C.sql_rstripped(_WRAPPED)}, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g')''')}) AS book FROM documents",
    "genre_labels": f"WITH s AS (SELECT doc_id, {_SUBJECT('doc_id')} AS s FROM documents), b AS (SELECT *, {C.sql_broad_genres('replace(lower(s), chr(59) || chr(32), chr(32) || chr(124) || chr(32))')} AS b FROM s) "
    f"SELECT doc_id, array_to_string({C.sql_title_genres('s')}, ',') AS title_genres, array_to_string(b, ',') AS broad_genres, {C.sql_control_token(chr(108) + 'ower(array_to_string(b, chr(32) || chr(124) || chr(32)))')} AS control_token FROM b",
    "creator_names": rf"""WITH v AS (SELECT c_custkey, c_mktsegment, {_CREATOR} AS value FROM customer), p AS (SELECT *, {_PARTS} AS parts FROM v),
      f AS (SELECT *, coalesce(regexp_replace(parts[1], '{_ROLE}', ''), 'unknown') AS name, CASE WHEN len(parts) = 0 THEN 'unknown' WHEN regexp_matches(parts[1], '{_ROLE}') THEN lower(regexp_extract(parts[1], '{_ROLE}', 1)) ELSE 'unspecified' END AS role FROM p)
      SELECT c_custkey, len(parts) AS creators, name, role, CASE WHEN role IN ('unspecified', 'author') THEN name END AS author,
        coalesce(nullif(trim(regexp_replace(regexp_replace(lower(name), ',?\s*(?:ca?\.\s*)?\d{{4}}\s*[-–]\s*(?:\d{{4}})?\s*$', ''), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ''), 'unknown') AS normalized,
        CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'project_gutenberg:pg-' || c_custkey WHEN c_custkey % 2 = 0 THEN 'project_gutenberg:' || lower(c_mktsegment) ELSE 'seed:' || lower(c_mktsegment) END AS collection_key,
        {_PUBLIC("value")} AS safely_public FROM f""",
    "heading_counts": f"SELECT doc_id, h AS heading, regexp_matches(h, '{_STRUCT}') AS structural, regexp_matches(h, '{_NON.replace(chr(39), chr(39) * 2)}') AS not_a_story, o AS opening FROM (SELECT doc_id, {_HEAD} AS h, sha256(array_to_string({X.SQL_WORDS}[1:40], ' ')) AS o FROM documents)",
    "canonical_records": f"SELECT 'pg-' || doc_id || '-' || left(sha256(doc_id || chr(0) || {_HEAD} || chr(0) || sha256({_T})), 12) AS id, 'pg-' || doc_id AS source_id, source AS source_collection, split_part({_T}, chr(10), 1) AS title, sha256({_T}) AS text_hash, "
    f"len({X.sql_split_words(_T)}) AS words, array_to_string({_GENRES}, '|') AS source_genres, array_to_string({C.sql_broad_genres('lower(array_to_string(' + _GENRES + ', chr(32) || chr(124) || chr(32)))')}, '|') AS broad_genres, 'https://example.org/' || doc_id || '.txt' AS source_url FROM documents",
    "record_identities": f"""SELECT doc_id, sha256({_JSON}) AS canonical_sha256, sha256({_LINE}) AS line_sha256, ('0x' || left(sha256('[1337,"' || source || '",' || doc_id || ']'), 16))::UBIGINT::VARCHAR AS seed,
      'review-' || left(sha256('["' || doc_id || '","' || sha256({_T}) || '","' || lang || '"]'), 20) AS review_id, 'owner-review-' || left(sha256('[260209,"' || doc_id || '"]'), 24) AS owner_review_id, {X.SQL_HASH} AS normalized_sha256 FROM documents""",
    "corpus_fingerprint": f"WITH b AS (SELECT doc_id // 4096 AS b, sha256(string_agg(sha256({_T}), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY b)) AS sha256, sum(n)::BIGINT AS lines FROM b",
    "prepared_records": _PREPARED,
    "preparation_counters": f"SELECT outcome, count(*) AS records FROM ({_PREPARED}) GROUP BY 1",
    "catalog_candidate_rows": rf"""WITH c AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 7 = 0 THEN 'Sound' ELSE 'Text' END AS type, CASE WHEN p_partkey % 5 = 0 THEN 'fr' ELSE 'en' END AS language, p_name AS title,
      CASE p_partkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'A, 18' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '-1960' ELSE 'B, 1820-1901' END AS authors, {_SUBJECT("p_partkey")} AS subjects FROM part)
      SELECT number, title, (NOT regexp_matches(title || ' ' || subjects, '(?i)detective|mystery|ghost|horror|science fiction|western|adventure|fantasy|weird|sea stor|short stor|tales|fables'))::INT AS later
      FROM c WHERE type = 'Text' AND language = 'en' AND (contains(lower(subjects), 'short stories') OR contains(lower(title), 'short stories')) AND NOT regexp_matches(lower(subjects), '\b(?:essays?|poetry|poems?)\b') AND {_PUBLIC("authors")}""",
}
