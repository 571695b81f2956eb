"""Distributions, concentration, splits, selection, contamination and packing audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import bounded, written
from ..sources.tables import table

SEED = 1337
CONTEXT = 1024


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("n_words", X.word_count(F.col("text")))


# Distributions -----------------------------------------------------------------------


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, nearest-rank p10/p90/p95/p99, interpolated median, mean and max."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("minimum"), rank(0.1).alias("p10"), F.median(value).alias("median"),
        F.round(F.avg(value), 9).alias("mean"), rank(0.9).alias("p90"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max(value).alias("maximum"),
    )


def length_distribution_by_lang(spark, sf_dir):
    return distribution(_docs(spark, sf_dir), "n_words", "lang")


def length_bands(spark, sf_dir):
    n = F.col("n_words")
    band = F.when(n < 500, "short").when(n < 3000, "medium").when(n < 10000, "long").otherwise("very_long")
    return _docs(spark, sf_dir).groupBy(band.alias("band"), "lang").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


# Concentration -----------------------------------------------------------------------


def concentration(df: DataFrame, key: str, weight: str) -> DataFrame:
    """One row: distinct keys, largest/top-10/top-20 shares by rows and by weight, both Herfindahl sums.

    No rows at all count as fully concentrated: shares of 1 over 0 keys.
    """
    g = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    # The ranking is over keys, not rows; only its first twenty are needed.
    tot = g.agg(F.count("*").alias("keys"), F.sum("n").alias("n_all"), F.sum("w").alias("w_all"),
                F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("w").cast("double") * F.col("w")).alias("w2"))
    top = lambda c: g.select(c, "k").orderBy(F.desc(c), "k").limit(20).agg(F.collect_list(c).alias(f"top_{c}"))
    out = tot.crossJoin(top("n")).crossJoin(top("w"))
    first = lambda c, m: F.when(F.col("keys") == 0, 1.0).otherwise(F.round(F.aggregate(F.slice(f"top_{c}", 1, m), F.lit(0.0), lambda a, x: a + x) / F.col(f"{c}_all"), 9))
    return out.select(
        "keys", *(first(c, m).alias(f"top{m}_{name}_share") for c, name in (("n", "row"), ("w", "weight")) for m in (1, 10, 20)),
        F.round(F.col("n2") / F.col("n_all") / F.col("n_all"), 9).alias("row_hhi"), F.round(F.col("w2") / F.col("w_all") / F.col("w_all"), 9).alias("weight_hhi"),
    )


def _concentration_sql(table_sql: str, key: str, weight: str) -> str:
    top = lambda c, m: f"round((SELECT sum(x) FROM (SELECT {c}::DOUBLE AS x FROM g ORDER BY {c} DESC, k LIMIT {m})) / sum({c}), 9)"
    shares = ", ".join(f"{top(c, m)} AS top{m}_{name}_share" for c, name in (("n", "row"), ("w", "weight")) for m in (1, 10, 20))
    return (
        f"WITH g AS (SELECT coalesce({key}::VARCHAR, 'unknown') AS k, count(*) AS n, sum({weight}) AS w FROM {table_sql} GROUP BY 1) "
        f"SELECT count(*) AS keys, {shares}, round(sum(n::DOUBLE * n) / sum(n) / sum(n), 9) AS row_hhi, round(sum(w::DOUBLE * w) / sum(w)::DOUBLE / sum(w)::DOUBLE, 9) AS weight_hhi FROM g"
    )


# Splits ------------------------------------------------------------------------------


def hash_splits(df: DataFrame, key: str, seed: int = SEED, train: float = 0.85, validation: float = 0.075) -> DataFrame:
    """Exact split sizes in the order of sha256(seed:id).

    The global rank comes in two levels, the hash's first three hex digits and the rows
    inside them, so no task sorts the whole table.
    """
    h = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    order = Window.orderBy("_b")
    counts = counts.select("_b", (F.sum("_c").over(order) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).join(F.broadcast(counts), "_b")
    r, n = F.col("_r") + F.col("_before"), F.col("_n")
    first, second = F.bround(n * train), F.bround(n * validation)
    split = F.when(r <= first, "train").when(r <= first + second, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_b", "_c", "_r", "_before", "_n")


def hash_split(spark, sf_dir):
    return hash_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def split_statistics(spark, sf_dir):
    return hash_splits(_docs(spark, sf_dir).select("doc_id", "lang", "n_words"), "doc_id").groupBy("split", "lang").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


def split_leakage(spark, sf_dir):
    """Normalised texts whose copies lie in more than one split."""
    rows = hash_splits(table(spark, sf_dir, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash")), "doc_id")
    return rows.groupBy("text_hash").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("documents")).where(F.size("splits") > 1)


def majority_split(spark, sf_dir):
    """Each source goes to the split that most of its labelled documents have."""
    rows = hash_splits(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    votes = rows.groupBy("source", "split").agg(F.count("*").alias("votes"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    return votes.groupBy("source").agg(F.max_by("split", F.struct("votes", -order)).alias("split"), F.max("votes").alias("votes"))


_SPLITS = f"""r AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id)) AS r, count(*) OVER () AS n FROM documents
), s AS (SELECT *, CASE WHEN r <= round_even(n * 0.85, 0) THEN 'train' WHEN r <= round_even(n * 0.85, 0) + round_even(n * 0.075, 0) THEN 'validation' ELSE 'test' END AS split FROM r)"""


# Selection ---------------------------------------------------------------------------


def stratified_sample(spark, sf_dir):
    """One document per (source, lang): that of the smallest seeded hash."""
    h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("source"), F.lit(":"), F.col("lang"), F.lit(":"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min_by("doc_id", h).alias("doc_id"), F.count("*").alias("stratum"))


def diverse_selection(spark, sf_dir, budget: int = 50_000):
    """Round robin over sources, longest first, until the word budget is reached.

    A source's first documents fill the budget alone, so only those of its longest lengths
    (found from counts a length) can come in: they are ranked, the rest are never sorted.
    """
    d = written(_docs(spark, sf_dir).select("doc_id", "source", "n_words"), "lengths")
    lengths = d.groupBy("source", "n_words").agg(F.sum("n_words").alias("w"))
    longer = Window.partitionBy("source").orderBy(F.desc("n_words"))
    cut = lengths.withColumn("before", F.sum("w").over(longer) - F.col("w")).where((F.col("before") < budget) & (F.col("n_words") > 0))
    cut = cut.groupBy(F.col("source").alias("of")).agg(F.min("n_words").alias("least"))
    d = d.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("of"))).where("n_words >= least").select("doc_id", "source", "n_words")
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_words"), "doc_id")))
    rounds = d.groupBy("turn").agg(F.sum("n_words").alias("w"))
    rounds = rounds.withColumn("before", F.sum("w").over(Window.orderBy("turn")) - F.col("w")).where(F.col("before") < budget).select("turn", "before")
    d = d.join(F.broadcast(rounds), "turn")
    inside = F.sum("n_words").over(Window.partitionBy("turn").orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_words")
    return d.withColumn("running", F.col("before") + inside).where(F.col("running") < budget).select("doc_id", "source", "turn", "n_words", "running")


def top_inefficient_lines(spark, sf_dir):
    """Ten lines of at least 20 words with the most characters a word (a top-k report)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))
    rows = rows.withColumn("words", X.word_count(F.col("line"))).where("words >= 20")
    rows = rows.withColumn("ratio", F.round(F.length("line") / F.col("words"), 9))
    return rows.orderBy(F.desc("ratio"), "doc_id", "line_no").limit(10).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "words", "ratio")


# Contamination -----------------------------------------------------------------------


def contamination(width: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(doc_id, item_id, shared): distinct shingles that a document shares with a benchmark item."""
        ref = table(spark, sf_dir, "benchmark").select("item_id", X.words(F.col("text")).alias("w")).where(F.size("w") >= width)
        # Items are few beside documents: their shingles are counted, and sent along if they may be.
        ref = bounded(written(ref.select("item_id", F.explode(X.shingles(F.col("w"), width)).alias("s")), "shingles"))
        docs = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).where(F.size("w") >= width)
        docs = docs.select("doc_id", F.explode(X.shingles(F.col("w"), width)).alias("s"))
        return docs.join(ref, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))

    return run


def _contamination_sql(width: int) -> str:
    part = lambda t, k: f"SELECT DISTINCT {k}, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT {k}, w, unnest(range(1, len(w) - {width - 2})) AS i FROM (SELECT {k}, {X.SQL_WORDS} AS w FROM {t}) WHERE len(w) >= {width})"
    return f"WITH d AS ({part('documents', 'doc_id')}), b AS ({part('benchmark', 'item_id')}) SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL"


# Packing -----------------------------------------------------------------------------


def chunk_rows(spark, sf_dir):
    """Chunks of at most CONTEXT next-word targets; a chunk never crosses documents."""
    d = _docs(spark, sf_dir).where("n_words > 1").select("doc_id", "n_words")
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_words") - 2) / CONTEXT))))
    return d.select("doc_id", "chunk", (F.col("chunk") * CONTEXT).alias("start"), F.least(F.lit(CONTEXT).cast("long"), F.col("n_words") - 1 - F.col("chunk") * CONTEXT).alias("targets"))


def chunk_statistics(spark, sf_dir):
    c = _docs(spark, sf_dir).where("n_words > 1").select(F.ceil((F.col("n_words") - 1) / CONTEXT).alias("chunks"), F.col("n_words"))
    band = F.when(F.col("chunks") == 1, "1").when(F.col("chunks") == 2, "2").when(F.col("chunks") <= 4, "3-4").otherwise("5+")
    return c.groupBy(band.alias("band")).agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum(F.col("n_words") - 1).alias("targets"),
        F.round(F.sum(F.col("n_words") - 1) / F.sum("chunks"), 9).alias("targets_per_chunk"),
    )


def schedule_arithmetic(spark, sf_dir, batch: int = 16, accumulation: int = 4, epochs: int = 15):
    chunks = chunk_rows(spark, sf_dir).agg(F.count("*").alias("sequences"), F.sum("targets").alias("targets"))
    return chunks.select(
        "sequences", "targets", F.lit(batch * CONTEXT).cast("long").alias("slots_per_microbatch"),
        F.ceil(F.col("sequences") / (batch * accumulation)).alias("steps_per_epoch"), (F.ceil(F.col("sequences") / (batch * accumulation)) * epochs).alias("steps"),
        F.round(1 - F.col("targets") / (F.col("sequences") * CONTEXT), 9).alias("padding_share"),
    )


QUERIES = {
    "length_distribution_by_lang": length_distribution_by_lang, "length_bands": length_bands,
    "source_concentration": lambda s, d: concentration(_docs(s, d), "source", "n_words"),
    "lang_concentration": lambda s, d: concentration(_docs(s, d), "lang", "n_words"),
    "supplier_concentration": lambda s, d: concentration(table(s, d, "lineitem"), "l_suppkey", "l_quantity"),
    "hash_split": hash_split, "split_statistics": split_statistics, "split_leakage": split_leakage, "majority_anchor_split": majority_split,
    "stratified_sample": stratified_sample, "diverse_selection_budget": diverse_selection, "top_inefficient_lines": top_inefficient_lines,
    "benchmark_contamination_5": contamination(5), "benchmark_contamination_8": contamination(8), "benchmark_contamination_12": contamination(12),
    "chunk_rows": chunk_rows, "chunk_statistics": chunk_statistics, "schedule_arithmetic": schedule_arithmetic,
}
_D = f"(SELECT *, {X.SQL_COUNT} AS n_words FROM documents)"
_CHUNKS = f"SELECT doc_id, n_words, unnest(range(0, (n_words - 2) // {CONTEXT} + 1)) AS chunk FROM {_D} WHERE n_words > 1"
ORACLE_SQL = {
    "length_distribution_by_lang": f"SELECT lang, count(*) AS n, min(n_words) AS minimum, quantile_disc(n_words, 0.1) AS p10, median(n_words) AS median, round(avg(n_words), 9) AS mean, quantile_disc(n_words, 0.9) AS p90, quantile_disc(n_words, 0.95) AS p95, quantile_disc(n_words, 0.99) AS p99, max(n_words) AS maximum FROM {_D} GROUP BY lang",
    "length_bands": f"SELECT CASE WHEN n_words < 500 THEN 'short' WHEN n_words < 3000 THEN 'medium' WHEN n_words < 10000 THEN 'long' ELSE 'very_long' END AS band, lang, count(*) AS documents, sum(n_words)::BIGINT AS words FROM {_D} GROUP BY ALL",
    "source_concentration": _concentration_sql(_D, "source", "n_words"),
    "lang_concentration": _concentration_sql(_D, "lang", "n_words"),
    "supplier_concentration": _concentration_sql("lineitem", "l_suppkey", "l_quantity"),
    "hash_split": f"WITH {_SPLITS} SELECT doc_id, split FROM s",
    "split_statistics": f"WITH {_SPLITS} SELECT split, lang, count(*) AS documents, sum({X.SQL_COUNT})::BIGINT AS words FROM s GROUP BY ALL",
    "split_leakage": f"WITH {_SPLITS} SELECT {X.SQL_HASH} AS text_hash, list(DISTINCT split ORDER BY split) AS splits, count(*) AS documents FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "majority_anchor_split": f"WITH {_SPLITS}, v AS (SELECT source, split, count(*) AS votes FROM s WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL) SELECT source, split, votes FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) = 1",
    "stratified_sample": f"SELECT source, lang, arg_min(doc_id, sha256('{SEED}:' || source || ':' || lang || ':' || doc_id)) AS doc_id, count(*) AS stratum FROM documents GROUP BY ALL",
    "diverse_selection_budget": f"WITH t AS (SELECT doc_id, source, n_words, row_number() OVER (PARTITION BY source ORDER BY n_words DESC, doc_id) AS turn FROM {_D}), r AS (SELECT *, sum(n_words) OVER (ORDER BY turn, source)::BIGINT - n_words AS running FROM t) SELECT doc_id, source, turn, n_words, running FROM r WHERE running < 50000",
    "top_inefficient_lines": f"WITH l AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, {X.SQL_LINES} AS l FROM documents)), w AS (SELECT doc_id, line_no, {X.SQL_COUNT} AS words, text FROM l) SELECT doc_id, line_no, words, round(length(text) / words, 9) AS ratio FROM w WHERE words >= 20 ORDER BY ratio DESC, doc_id, line_no LIMIT 10",
    **{f"benchmark_contamination_{k}": _contamination_sql(k) for k in (5, 8, 12)},
    "chunk_rows": f"SELECT doc_id, chunk, chunk * {CONTEXT} AS start, least({CONTEXT}, n_words - 1 - chunk * {CONTEXT}) AS targets FROM ({_CHUNKS})",
    "chunk_statistics": f"SELECT CASE WHEN c = 1 THEN '1' WHEN c = 2 THEN '2' WHEN c <= 4 THEN '3-4' ELSE '5+' END AS band, count(*) AS documents, sum(c)::BIGINT AS chunks, sum(n_words - 1)::BIGINT AS targets, round(sum(n_words - 1) / sum(c), 9) AS targets_per_chunk FROM (SELECT n_words, ceil((n_words - 1) / {CONTEXT})::BIGINT AS c FROM {_D} WHERE n_words > 1) GROUP BY 1",
    "schedule_arithmetic": f"SELECT count(*) AS sequences, sum(t)::BIGINT AS targets, {16 * CONTEXT}::BIGINT AS slots_per_microbatch, ceil(count(*) / 64)::BIGINT AS steps_per_epoch, ceil(count(*) / 64)::BIGINT * 15 AS steps, round(1 - sum(t) / (count(*) * {CONTEXT}), 9) AS padding_share FROM (SELECT least({CONTEXT}, n_words - 1 - chunk * {CONTEXT}) AS t FROM ({_CHUNKS}))",
}
