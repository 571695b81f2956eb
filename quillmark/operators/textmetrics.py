"""Text metrics: repetition, dialogue, chunk boundaries, mentions of facts, array tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table

# Words that negate a mention, that tie a value to a state, and that mark a cause.
NEGATIONS = ("isn't", "never", "no", "not", "wasn't", "without", "wrong")
COPULAS = ("is", "means", "was")
QUOTES = "\"“”‘’"
#: Characters between the cuts of the boundary query.
CUT = 4096


# Repetition ---------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space, lower-cased and squeezed, blank ones left out."""
    parts = F.split(X.body(text), rf"(?<=[.!?]){X.SPACE}+", -1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.lower(X.strip(x)), f"{X.SPACE}+", " ")), lambda x: x != "")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0)), 9)


def repetition(docs: DataFrame, key: str, tokens: str, text: str) -> DataFrame:
    """(key, token_count, distinct_1..3, repeated_4gram_rate, sentence_count, repeated_sentence_rate).

    ``tokens`` is an array of strings; runs of tokens are compared as 64-bit hashes inside a row.
    """
    t = F.col(tokens)
    runs = lambda k: F.when(
        F.size(t) >= k, F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(k))))
    ).otherwise(F.array().cast("array<long>"))
    d = docs.select(key, F.size(t).cast("long").alias("token_count"), *(runs(k).alias(f"_g{k}") for k in (1, 2, 3, 4)), sentences(F.col(text)).alias("_s"))
    distinct = lambda c: F.size(F.array_distinct(c))
    return d.select(
        key, "token_count", *(_share(distinct(f"_g{k}"), F.size(f"_g{k}")).alias(f"distinct_{k}") for k in (1, 2, 3)),
        _share(F.size("_g4") - distinct("_g4"), F.size("_g4")).alias("repeated_4gram_rate"), F.size("_s").cast("long").alias("sentence_count"),
        _share(F.size("_s") - distinct("_s"), F.size("_s")).alias("repeated_sentence_rate"),
    )


def repetition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", X.words(F.col("text")).alias("w"))
    return repetition(docs, "doc_id", "w", "text")


def repetition_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean repetition metrics of each language."""
    d = repetition_metrics(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    names = ("distinct_1", "distinct_2", "distinct_3", "repeated_4gram_rate", "repeated_sentence_rate")
    return d.groupBy("lang").agg(F.count("*").alias("documents"), *(F.round(F.avg(n), 7).alias(n) for n in names))


def longest_repeated_span(tokens: list) -> int:
    """Length of the longest run that comes again without overlapping its first place.

    If a run of length n does, its beginnings do, so the length is found by bisection;
    runs are compared by a 64-bit rolling sum and checked token by token.
    """
    _, ids = np.unique(np.asarray(tokens, object).astype(str), return_inverse=True) if tokens else (None, np.zeros(0, int))
    n, base = len(ids), np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(31)
        power = np.cumprod(np.full(n + 1, base, np.uint64), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n], dtype=np.uint64)])

        def repeated(width: int) -> bool:
            h = (total[width:] - total[: n - width + 1]) * power[n - np.arange(n - width + 1)]
            order = np.lexsort((np.arange(len(h)), h))
            new = np.append(True, h[order][1:] != h[order][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            for j in np.flatnonzero(order - first >= width):
                a, b = first[j], order[j]
                if np.array_equal(ids[a : a + width], ids[b : b + width]):
                    return True
            return False

        low, high = 0, n // 2
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if repeated(middle) else (low, middle - 1)
    return low


def longest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, longest_repeated_span) over words; an Arrow function, as Spark has no such search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_repeated_span(w or []) for w in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "longest_repeated_span"])

    return table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).mapInArrow(run, "doc_id long, longest_repeated_span long")


# Dialogue -----------------------------------------------------------------------------

_WORD = re.compile(r"\b[\w’'-]+\b")
_QUOTE = re.compile("[\"“”‘’]")
_BLANK = re.compile(r"\n\s*\n")
_OPENS, _CLOSES = {"“": "double", "‘": "single"}, {"”": "double", "’": "single"}


def quote_spans(text: str) -> tuple[int, int, int, int]:
    """(words inside outer spans that close, re-opened paragraphs, spans left open, closings without an opening).

    Quotes nest; a paragraph may open with the quote that is still open, and an apostrophe
    after a letter or digit closes nothing.  What a paragraph ends inside goes on in the next.
    """
    open_: list[str] = []
    inside: list[str] = []
    words = again = lost = 0
    for paragraph in (p.strip() for p in _BLANK.split(text)):
        at = 0
        for m in _QUOTE.finditer(paragraph):
            quote, k = m.group(), m.start()
            if open_:
                inside.append(paragraph[at:k])
            at, kind = k + 1, _OPENS.get(quote) or _CLOSES.get(quote) or "straight"
            same = bool(open_) and open_[-1] == kind
            if quote in _CLOSES:
                if same:
                    open_.pop()
                elif not (quote == "’" and k and paragraph[k - 1].isalnum()):
                    lost += 1
            elif same and k == 0:
                again += 1
            elif same and quote == '"':
                open_.pop()
            else:
                open_.append(kind)
            if not open_ and inside:
                words += len(_WORD.findall("".join(inside)))
                inside.clear()
        if open_:
            inside += [paragraph[at:], "\n"]
    return words, again, int(bool(open_)), lost


def dialogue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote machine's counts of every document, paragraph by paragraph in an Arrow function."""
    names = ("closed_quote_span_words", "paragraph_reopen_count", "unclosed_quote_span_count", "unmatched_closing_quote_count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [quote_spans((t or "").replace("\n", "\n\n")) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *names])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def dialogue_counts(text: Column, blank_line: str = r"\n\s*\n") -> dict[str, Column]:
    """Words, paragraphs, paragraphs that open with a quote and their share, quote marks and their rate."""
    raw = X.body(text)
    words = F.regexp_count(raw, F.lit(r"[\p{L}\p{N}_’'-]*[\p{L}\p{N}_][\p{L}\p{N}_’'-]*")).cast("long")
    parts = F.filter(F.transform(F.split(raw, blank_line, -1), X.strip), lambda x: x != "")
    opening = F.size(F.filter(parts, lambda x: x.rlike("^[\"“‘']"))).cast("long")
    marks = (F.length(raw) - F.length(F.translate(raw, QUOTES, ""))).cast("long")
    return {
        "words": words, "paragraphs": F.size(parts).cast("long"), "dialogue_opening_paragraphs": opening,
        "dialogue_opening_paragraph_share": F.round(opening / F.greatest(F.lit(1), F.size(parts)), 9),
        "quote_mark_count": marks, "quote_marks_per_1000_words": F.round(1000.0 * marks / F.greatest(F.lit(1), words), 9),
    }


def inside_dialogue(prefix: Column) -> Column:
    """Whether a text ends inside quotes: odd straight ones, or a last opener after the last closer."""
    last = lambda q: F.when(F.instr(prefix, q) > 0, F.length(prefix) - F.length(F.substring_index(prefix, q, -1))).otherwise(0)
    odd = (F.length(prefix) - F.length(F.replace(prefix, F.lit('"'), F.lit("")))) % 2 == 1
    return odd | (last("“") > last("”")) | (last("‘") > last("’"))


def dialogue_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in dialogue_counts(text, r"\n").items()), inside_dialogue(X.body(text)).alias("ends_inside"))


# Boundaries ---------------------------------------------------------------------------


def boundary_flags(left: Column, right: Column, inside: Column) -> dict[str, Column]:
    """Flags of a cut between two texts and the primary one, by precedence.

    ``inside`` says whether all text before the cut ends inside dialogue.
    """
    paragraph = left.rlike(rf"\n{X.SPACE}*\n{X.SPACE}*$")
    line = ~paragraph & left.rlike(r"\n[ \t]*$")
    sentence = left.rlike(rf"[.!?][\"'”’)]?{X.SPACE}*$")
    dialogue = inside | right.rlike(f"^{X.SPACE}*[{QUOTES}]")
    subword = left.rlike(r"[\p{L}\p{N}]$") & right.rlike(r"^[\p{L}\p{N}]")
    primary = (
        F.when(paragraph, "paragraph").when(line, "line").when(sentence, "sentence").when(dialogue, "dialogue").when(subword, "subword").otherwise("token")
    )
    return {"primary": primary, "paragraph": paragraph, "line": line, "sentence": sentence, "dialogue": dialogue, "subword": subword}


def boundary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the cuts at every CUT characters of every document.

    What is open before a cut comes from running sums over a document's pieces, so a long
    text costs its length and no prefix is copied.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", X.body(F.col("text")).alias("t"))
    p = d.select("doc_id", F.length("t").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / CUT).cast("int")), lambda i: F.substring("t", i * CUT + 1, F.lit(CUT)))).alias("k", "piece"))
    last = lambda q: F.when(F.instr("piece", q) > 0, F.col("k") * CUT + F.length("piece") - F.length(F.substring_index("piece", q, -1)))
    straight = F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = lambda q: F.coalesce(F.max(last(q)).over(before), F.lit(0))
    inside = (F.sum(straight).over(before) % 2 == 1) | (top("“") > top("”")) | (top("‘") > top("’"))
    p = p.withColumn("inside", inside).withColumn("right", F.lead(F.substring("piece", 1, 200)).over(Window.partitionBy("doc_id").orderBy("k")))
    p = p.where("right IS NOT NULL").withColumn("left", F.substring("piece", -200, 200))
    return p.select("doc_id", F.col("k").cast("long").alias("cut"), *(c.alias(n) for n, c in boundary_flags(F.col("left"), F.col("right"), F.col("inside")).items()))


def utf8_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cut at every CUT bytes of a document falls inside a character."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.body(F.col("text")).cast("binary").alias("b"))
    cuts = F.sequence(F.lit(1), F.floor((F.octet_length("b") - 1) / CUT).cast("int"))
    d = d.where(F.octet_length("b") > CUT).select("doc_id", F.explode(F.transform(cuts, lambda i: F.struct(i.alias("k"), F.hex(F.substring("b", i * CUT + 1, F.lit(1))).alias("h")))).alias("c"))
    return d.select("doc_id", F.col("c.k").cast("long").alias("cut"), F.col("c.h").rlike("^[89AB]").alias("splits_character"))


# Mentions -----------------------------------------------------------------------------


def fact_words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(X.body(text)), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def contains_phrase(text: Column, phrase_words: Column) -> Column:
    """Whether the words of a phrase stand in a text, white space between them, no letter or digit beside."""
    quoted = F.transform(phrase_words, lambda w: F.regexp_replace(w, r"([^a-z0-9])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.array_join(quoted, rf"{X.SPACE}+"), F.lit(r"(?![\p{L}\p{N}_])"))
    return (F.size(phrase_words) > 0) & F.regexp_like(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), pattern)


def contains_run(values: Column, run: Column) -> Column:
    """Whether an array holds another as a contiguous run; an empty run is in none."""
    places = F.when(F.size(values) >= F.size(run), F.sequence(F.lit(1), F.size(values) - F.size(run) + 1)).otherwise(F.array().cast("array<int>"))
    return (F.size(run) > 0) & F.exists(places, lambda i: F.slice(values, i, F.size(run)) == run)


def mention(words: Column, value: Column) -> Column:
    """struct(mentioned, negated): a value's words in a text's words, and whether a negation
    stands right before one of its places or follows it after a copula."""
    n = F.size(value)
    places = F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: F.slice(words, i, n) == value)
    word = lambda i: F.coalesce(F.get(words, i - 1), F.lit(""))
    negated = F.exists(hits, lambda i: word(i - 1).isin(*NEGATIONS) | (word(i + n).isin(*COPULAS) & word(i + n + 1).isin(*NEGATIONS)))
    return F.struct((F.size(hits) > 0).alias("mentioned"), negated.alias("negated"))


def asserted(text: Column, value: Column, entities: Column, state_term: Column, relations: tuple[str, ...]) -> Column:
    """Whether one sentence names the value without negation, the state's term, an entity and a relation word."""
    parts = F.split(X.body(text), rf"(?<=[.!?]){X.SPACE}+|\n+", -1)

    def holds(s):
        words = fact_words(s)
        m = mention(words, value)
        return m["mentioned"] & ~m["negated"] & F.array_contains(words, state_term) & F.exists(entities, lambda e: contains_phrase(s, fact_words(e))) & F.arrays_overlap(words, F.array(*map(F.lit, relations)))

    return F.exists(parts, holds)


def fact_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: are the words 3-4 of the document before it (by id) mentioned, negated, a phrase?

    Documents with fewer words give false; ids are consecutive, so the one before is found by an equi-join.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", fact_words(F.col("text")).alias("w"))
    value = d.select((F.col("doc_id") + 1).alias("doc_id"), F.slice("w", 3, 2).alias("value"))
    d = d.join(value, "doc_id")
    m = mention(F.col("w"), F.col("value"))
    return d.select("doc_id", m["mentioned"].alias("mentioned"), m["negated"].alias("negated"), contains_run(F.col("w"), F.col("value")).alias("contains_run"))


# Arrays and schedules -------------------------------------------------------------------


def first_divergence(gold: Column, made: Column) -> Column:
    """First place, from 0, where two arrays differ or one has ended; null if they are equal."""
    at = F.array_position(F.zip_with(gold, made, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(at > 0, at - 1)


def recovery_error(gold: Column, recovered: Column) -> Column:
    return F.array_max(F.zip_with(gold, recovered, lambda a, b: F.abs(a - b)))


def replaced_tail(prefix: Column, generated: Column, length: Column) -> Column:
    """``prefix`` with its last ``length`` elements replaced by the first of ``generated``."""
    return F.concat(F.slice(prefix, 1, F.size(prefix) - length), F.slice(generated, 1, length))


def depth_bucket(depth: Column) -> Column:
    return F.when(depth <= 3, depth.cast("string")).otherwise("4+")


def learning_rate(step: Column, most: int, warm_up: int, peak: float, floor: float) -> Column:
    """Rate of steps 1 to ``most``: linear warm-up, then half a cosine down to ``floor``."""
    done = (step - warm_up) / max(1, most - warm_up)
    return F.when(step <= warm_up, peak * step / warm_up).otherwise(floor + 0.5 * (1 + F.cos(F.pi() * done)) * (peak - floor))


def fact_visibility(prompt_tokens: Column, context: int, new_tokens: int) -> dict[str, Column]:
    """Context-window arithmetic of a prompt with two control tokens.

    ``leaves`` marks prompts whose facts are visible at first and pushed out while new tokens are made.
    """
    start = prompt_tokens + 2
    at_start, throughout = start <= context, start + new_tokens <= context
    return {"maximum_tokens": start + new_tokens, "visible_at_start": at_start, "visible_throughout": throughout, "leaves": at_start & ~throughout}


def visible_facts(spark: SparkSession, sf_dir: str, context: int = 1024, new_tokens: int = 256) -> DataFrame:
    n = X.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in fact_visibility(n, context, new_tokens).items()))


def turn_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a turn against those of the turn before: first divergence, shared run, replaced tail."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    c = c.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    tail = replaced_tail(F.col("before"), F.col("w"), F.least(F.lit(3), F.size("before"), F.size("w")))
    return c.select(
        "conv_id", "turn", first_divergence(F.col("before"), F.col("w")).alias("first_divergence"),
        contains_run(F.col("w"), F.slice("before", 1, 2)).alias("keeps_opening"), F.array_join(tail, " ").alias("replaced"),
        depth_bucket(F.col("turn") + 1).alias("depth"),
    )


def embedding_recovery(spark: SparkSession, sf_dir: str, tolerance: float = 0.05) -> DataFrame:
    """Largest error of embeddings rounded to one decimal, and whether it lies within the tolerance."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    error = recovery_error(e, F.transform(e, lambda x: F.floor(x * 10 + 0.5) / 10))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(error, 7).alias("max_error"), (error <= tolerance).alias("within"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each step of a schedule as long as the documents are many."""
    n = table(spark, sf_dir, "documents").count()
    step = F.col("id")
    return spark.range(1, n + 1).select(step.alias("step"), F.round(learning_rate(step, n, max(1, round(n * 0.05)), 3e-4, 3e-5), 12).alias("rate"))


QUERIES = {
    "repetition_metrics": repetition_metrics, "repetition_by_language": repetition_by_language, "longest_spans": longest_spans,
    "dialogue_basic": dialogue_basic, "dialogue_spans": dialogue_spans, "boundary_classes": boundary_classes, "utf8_cuts": utf8_cuts,
    "fact_mentions": fact_mentions, "visible_facts": visible_facts, "turn_divergence": turn_divergence, "embedding_recovery": embedding_recovery,
    "learning_rates": learning_rates,
}

_T = "coalesce(text, '')"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_T}, '([.!?]){X.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(lower({X.sql_strip('x')}), '{X.SPACE}+', ' ', 'g')), lambda x: x <> '')"
_share_sql = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 9)"
# Runs by lead(): a list in a lambda would be copied for every element.
_REPETITION = (
    f"SELECT doc_id, lang, len(w)::BIGINT AS token_count, {_share_sql('n1', 'len(w)')} AS distinct_1, CASE WHEN len(w) >= 2 THEN {_share_sql('n2', '(len(w) - 1)')} ELSE 0 END AS distinct_2, CASE WHEN len(w) >= 3 THEN {_share_sql('n3', '(len(w) - 2)')} ELSE 0 END AS distinct_3, "
    f"CASE WHEN len(w) >= 4 THEN {_share_sql('(len(w) - 3 - n4)', '(len(w) - 3)')} ELSE 0 END AS repeated_4gram_rate, len(s)::BIGINT AS sentence_count, {_share_sql('(len(s) - len(list_distinct(s)))', 'len(s)')} AS repeated_sentence_rate "
    f"FROM (SELECT doc_id, lang, {X.SQL_WORDS} AS w, {_SENTENCES} AS s FROM documents) LEFT JOIN (SELECT doc_id, count(DISTINCT x) AS n1, count(DISTINCT x || ' ' || a) AS n2, count(DISTINCT x || ' ' || a || ' ' || b) AS n3, count(DISTINCT x || ' ' || a || ' ' || b || ' ' || c) AS n4 "
    f"FROM (SELECT doc_id, x, lead(x, 1) OVER o AS a, lead(x, 2) OVER o AS b, lead(x, 3) OVER o AS c FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT doc_id, {X.SQL_WORDS} AS w FROM documents)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id) USING (doc_id)"
)
_DQ = "len({0}) - len(replace({0}, '\"', ''))"
_LAST = lambda x, q: f"(CASE WHEN contains({x}, '{q}') THEN len({x}) - instr(reverse({x}), '{q}') + 1 ELSE 0 END)"
_INSIDE = lambda x: f"(({_DQ.format(x)}) % 2 = 1 OR {_LAST(x, '“')} > {_LAST(x, '”')} OR {_LAST(x, '‘')} > {_LAST(x, '’')})"
_FW = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9]+(?:''[a-z]+)?')"
_NEG = ", ".join("'" + n.replace("'", "''") + "'" for n in NEGATIONS)
_COP = ", ".join(f"'{c}'" for c in COPULAS)
ORACLE_SQL = {
    "repetition_metrics": f"SELECT * EXCLUDE (lang) FROM ({_REPETITION})",
    "repetition_by_language": f"SELECT lang, count(*) AS documents, {', '.join(f'round(avg({n}), 7) AS {n}' for n in ('distinct_1', 'distinct_2', 'distinct_3', 'repeated_4gram_rate', 'repeated_sentence_rate'))} FROM ({_REPETITION}) GROUP BY lang",
    "dialogue_basic": rf"""SELECT doc_id, words, paragraphs, dialogue_opening_paragraphs, round(dialogue_opening_paragraphs / greatest(1, paragraphs), 9) AS dialogue_opening_paragraph_share,
      quote_mark_count, round(1000.0 * quote_mark_count / greatest(1, words), 9) AS quote_marks_per_1000_words, {_INSIDE("t")} AS ends_inside
      FROM (SELECT doc_id, t, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_’''-]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_’''-]*')) AS words, len(p) AS paragraphs, len(list_filter(p, lambda x: regexp_matches(x, '^["“‘'']'))) AS dialogue_opening_paragraphs,
      len(t) - len(translate(t, '"“”‘’', '')) AS quote_mark_count FROM (SELECT doc_id, {_T} AS t, list_filter(list_transform(string_split({_T}, chr(10)), lambda x: {X.sql_strip("x")}), lambda x: x <> '') AS p FROM documents))""",
    "boundary_classes": rf"""WITH c AS (SELECT doc_id, t, unnest(range(1, (len(t) - 1) // {CUT} + 1)) AS k FROM (SELECT doc_id, {_T} AS t FROM documents)),
      x AS (SELECT doc_id, k - 1 AS cut, substr(t, 1, k * {CUT}) AS pre, right(substr(t, 1, k * {CUT}), 200) AS l, substr(t, k * {CUT} + 1, 200) AS r FROM c),
      f AS (SELECT doc_id, cut, regexp_matches(l, '\n{X.SPACE}*\n{X.SPACE}*$') AS paragraph, regexp_matches(l, '\n[ \t]*$') AS nl, regexp_matches(l, '[.!?]["''”’)]?{X.SPACE}*$') AS sentence,
        {_INSIDE("pre")} OR regexp_matches(r, '^{X.SPACE}*["“”‘’]') AS dialogue, regexp_matches(l, '[\p{{L}}\p{{N}}]$') AND regexp_matches(r, '^[\p{{L}}\p{{N}}]') AS subword FROM x)
      SELECT doc_id, cut, CASE WHEN paragraph THEN 'paragraph' WHEN nl THEN 'line' WHEN sentence THEN 'sentence' WHEN dialogue THEN 'dialogue' WHEN subword THEN 'subword' ELSE 'token' END AS "primary", paragraph, NOT paragraph AND nl AS line, sentence, dialogue, subword FROM f""",
    "utf8_cuts": f"SELECT doc_id, k AS cut, substr(h, 2 * k * {CUT} + 1, 1) IN ('8', '9', 'A', 'B') AS splits_character FROM (SELECT doc_id, hex(encode({_T})) AS h, unnest(range(1, (strlen({_T}) - 1) // {CUT} + 1)) AS k FROM documents)",
    "fact_mentions": f"""WITH d AS (SELECT doc_id, {_FW} AS w FROM documents), j AS (SELECT a.doc_id, a.w, b.w[3:4] AS v FROM d a JOIN d b ON b.doc_id + 1 = a.doc_id),
      h AS (SELECT *, CASE WHEN len(v) > 0 THEN list_filter(range(1, len(w) - len(v) + 2), lambda i: w[i:i + len(v) - 1] = v) ELSE [] END AS p FROM j)
      SELECT doc_id, len(p) > 0 AS mentioned, len(list_filter(p, lambda i: (i > 1 AND w[i - 1] IN ({_NEG})) OR (coalesce(w[i + len(v)], '') IN ({_COP}) AND coalesce(w[i + len(v) + 1], '') IN ({_NEG})))) > 0 AS negated, len(p) > 0 AS contains_run FROM h""",
    "visible_facts": f"SELECT doc_id, n + 258 AS maximum_tokens, n + 2 <= 1024 AS visible_at_start, n + 258 <= 1024 AS visible_throughout, n + 2 <= 1024 AND n + 258 > 1024 AS leaves FROM (SELECT doc_id, {X.SQL_COUNT} AS n FROM documents)",
    "turn_divergence": f"""WITH c AS (SELECT conv_id, turn, {X.SQL_WORDS} AS w FROM conversations), b AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c), n AS (SELECT *, least(3, len(p), len(w)) AS k FROM b WHERE p IS NOT NULL)
      SELECT conv_id, turn, list_min(list_filter(range(0, greatest(len(p), len(w))), lambda i: p[i + 1] IS DISTINCT FROM w[i + 1])) AS first_divergence,
        len(p[1:2]) > 0 AND len(list_filter(range(1, len(w) - len(p[1:2]) + 2), lambda i: w[i:i + len(p[1:2]) - 1] = p[1:2])) > 0 AS keeps_opening,
        array_to_string(p[1:len(p) - k] || w[1:k], ' ') AS replaced, CASE WHEN turn + 1 <= 3 THEN (turn + 1)::VARCHAR ELSE '4+' END AS depth FROM n""",
    "embedding_recovery": "SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - floor(x::DOUBLE * 10 + 0.5) / 10))), 7) AS max_error, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - floor(x::DOUBLE * 10 + 0.5) / 10))) <= 0.05 AS within FROM embeddings",
    "learning_rates": "WITH n AS (SELECT count(*) AS n, greatest(1, round_even(count(*) * 0.05, 0))::BIGINT AS u FROM documents), s AS (SELECT unnest(range(1, n + 1)) AS step, n, u FROM n) SELECT step, round(CASE WHEN step <= u THEN 0.0003::DOUBLE * step / u ELSE 0.00003::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * ((step - u) / greatest(1, n - u)))) * (0.0003::DOUBLE - 0.00003::DOUBLE) END, 12) AS rate FROM s",
}
