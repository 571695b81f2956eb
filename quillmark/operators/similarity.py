"""Similarity candidates by bottom-k shingle hashes, benchmark containment and document offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import bounded, written
from ..sources.tables import table

WIDTH, FINGERPRINT, SHARED, POSTING, REJECT = 5, 48, 4, 32, 0.88
LONG = 12
RANGE = 1024


def bottom_k_postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, s): shingle sets, (h, id): the FINGERPRINT smallest shingle hashes), both written once."""
    w = df.select(F.col(key).alias("id"), X.words(F.col(text)).alias("w"))
    # A condition on the shingles would be pushed below the words and split the text for each of them.
    d = written(w.where(F.size("w") > 0).select("id", X.shingles(F.col("w"), WIDTH).alias("s")), "shingles")
    smallest = F.slice(F.array_sort(F.transform("s", lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 16))), 1, FINGERPRINT)
    return d, written(d.select("id", F.explode(smallest).alias("h")), "postings")


def bottom_k_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(left_id, right_id, shared, jaccard, rejected): pairs that share SHARED of their FINGERPRINT smallest shingle hashes.

    Postings of more than POSTING documents are left out, as the rule says, and their
    number is the business of ``skipped_postings``; a posting gives a bounded number of pairs.
    """
    d, post = bottom_k_postings(df, key, text)
    useful = post.groupBy("h").agg(F.count("*").alias("n")).where(f"n BETWEEN 2 AND {POSTING}").select("h")
    post = written(post.join(useful, "h"), "useful")
    other = post.select("h", F.col("id").alias("right_id"))
    pairs = post.withColumnRenamed("id", "left_id").join(other, "h").where("left_id < right_id")
    pairs = pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).where(f"shared >= {SHARED}")
    side = lambda name, s: d.select(F.col("id").alias(name), F.col("s").alias(s))
    pairs = pairs.join(side("left_id", "a"), "left_id").join(side("right_id", "b"), "right_id")
    both = F.size(F.array_intersect("a", "b"))
    jaccard = F.round(both / (F.size("a") + F.size("b") - both), 9)
    return pairs.select("left_id", "right_id", "shared", jaccard.alias("jaccard"), (jaccard >= REJECT).alias("rejected"))


def skipped_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the similarity audit leaves out: postings of more than POSTING documents, and documents with such a hash."""
    _, post = bottom_k_postings(table(spark, sf_dir, "documents"))
    common = written(post.groupBy("h").agg(F.count("*").alias("n")).where(f"n > {POSTING}"), "common")
    touched = post.join(bounded(common.select("h")), "h", "left_semi").agg(F.countDistinct("id").alias("documents"))
    return common.agg(F.count("*").alias("skipped"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).crossJoin(touched)


def bottom_k_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k_pairs(table(spark, sf_dir, "documents"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, kind, evidence): exact text, contained item, or the smallest shared LONG-word shingle.

    Items of fewer than LONG words have no such shingle: they are found whole among the
    documents' runs of as many words, and are their own evidence.
    """
    return containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    split = lambda df, key: df.select(key, X.words(F.col("text")).alias("w"))
    long = lambda df, key: split(df, key).where(F.size("w") >= LONG)
    shingled = lambda df, key: long(df, key).select(key, F.explode(X.shingles(F.col("w"), LONG)).alias("s"))
    hits = shingled(docs, "doc_id").join(shingled(items, "item_id"), "s").groupBy("doc_id", "item_id").agg(F.min("s").alias("evidence"))
    joined = lambda df, key, to: long(df, key).select(key, F.array_join("w", " ").alias(to))
    hits = hits.join(joined(items, "item_id", "item"), "item_id").join(joined(docs, "doc_id", "doc"), "doc_id")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    kind = F.when(F.col("doc") == F.col("item"), "exact").when(F.contains(padded("doc"), padded("item")), "containment").otherwise("shingle")
    hits = hits.select("doc_id", "item_id", kind.alias("kind"), "evidence")
    short = split(items, "item_id").where(F.size("w").between(1, LONG - 1)).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("evidence"))
    # Every document with each length that a short item has, LONG - 1 at most.
    d = split(docs, "doc_id").crossJoin(F.broadcast(short.select("n").distinct())).where(F.size("w") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    d = d.select("doc_id", (F.size("w") == F.col("n")).alias("whole"), F.explode(F.array_distinct(runs)).alias("evidence"))
    found = d.join(short.drop("n"), "evidence")
    return hits.union(found.select("doc_id", "item_id", F.when(F.col("whole"), "exact").otherwise("containment").alias("kind"), "evidence"))


def running_offsets(df: DataFrame, key: str, size: str) -> DataFrame:
    """``df`` with start_offset: the sizes of all rows of smaller key (unique, orderable) summed.

    Two levels: up to 256 ranges of the key, cut at its quantiles, and the rows inside;
    so neither dense nor sparse keys bring the table into one task.
    """
    total = df.count()
    cuts = max(1, min(256, int(total**0.5)))
    bounds = df.agg(F.percentile_approx(key, [k / cuts for k in range(1, cuts)] or [0.5], 10 * cuts).alias("b"))
    d = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("b", lambda x: x < F.col(key)))).drop("b") if total > RANGE else df.withColumn("_range", F.lit(0))
    sums = d.groupBy("_range").agg(F.sum(size).alias("_c"))
    sums = sums.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.sum(size).over(inside) - F.col(size)).join(F.broadcast(sums), "_range")
    return d.withColumn("start_offset", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))
    return running_offsets(d, "doc_id", "n_words")


QUERIES = {"bottom_k_candidates": bottom_k_candidates, "skipped_postings": skipped_postings, "benchmark_containment": benchmark_containment, "pack_offsets": pack_offsets}


def _set(width: int) -> str:
    return f"list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')))"


_LONG = lambda t, k: f"SELECT {k}, w, unnest({_set(LONG)}) AS s FROM (SELECT {k}, {X.SQL_WORDS} AS w FROM {t}) WHERE len(w) >= {LONG}"
ORACLE_SQL = {
    "bottom_k_candidates": f"WITH d AS (SELECT doc_id AS id, CASE WHEN len(w) >= {WIDTH} THEN {_set(WIDTH)} ELSE [array_to_string(w, ' ')] END AS s FROM (SELECT doc_id, {X.SQL_WORDS} AS w FROM documents) WHERE len(w) > 0), "
    f"p AS (SELECT id, unnest(list_sort(list_transform(s, lambda x: left(sha256(x), 16)))[1:{FINGERPRINT}]) AS h FROM d), u AS (SELECT h FROM p GROUP BY h HAVING count(*) BETWEEN 2 AND {POSTING}), q AS (SELECT * FROM p WHERE h IN (SELECT h FROM u)), "
    f"c AS (SELECT x.id AS left_id, y.id AS right_id, count(*) AS shared FROM q x JOIN q y ON x.h = y.h AND x.id < y.id GROUP BY ALL HAVING count(*) >= {SHARED}), "
    f"j AS (SELECT c.*, len(list_intersect(a.s, b.s)) AS n, len(a.s) + len(b.s) AS m FROM c JOIN d a ON a.id = left_id JOIN d b ON b.id = right_id) SELECT left_id, right_id, shared, round(n / (m - n), 9) AS jaccard, round(n / (m - n), 9) >= {REJECT} AS rejected FROM j",
    "skipped_postings": f"WITH d AS (SELECT doc_id AS id, CASE WHEN len(w) >= {WIDTH} THEN {_set(WIDTH)} ELSE [array_to_string(w, ' ')] END AS s FROM (SELECT doc_id, {X.SQL_WORDS} AS w FROM documents) WHERE len(w) > 0), "
    f"p AS (SELECT id, unnest(list_sort(list_transform(s, lambda x: left(sha256(x), 16)))[1:{FINGERPRINT}]) AS h FROM d), c AS (SELECT h, count(*) AS n FROM p GROUP BY h HAVING count(*) > {POSTING}) SELECT (SELECT count(*) FROM c) AS skipped, (SELECT coalesce(max(n), 0) FROM c) AS largest, (SELECT count(DISTINCT id) FROM p WHERE h IN (SELECT h FROM c)) AS documents",
    "benchmark_containment": f"WITH d AS ({_LONG('documents', 'doc_id')}), b AS ({_LONG('benchmark', 'item_id')}), h AS (SELECT doc_id, item_id, min(s) AS evidence, any_value(array_to_string(d.w, ' ')) AS doc, any_value(array_to_string(b.w, ' ')) AS item FROM d JOIN b USING (s) GROUP BY ALL) "
    "SELECT doc_id, item_id, CASE WHEN doc = item THEN 'exact' WHEN contains(' ' || doc || ' ', ' ' || item || ' ') THEN 'containment' ELSE 'shingle' END AS kind, evidence FROM h",
    "pack_offsets": f"SELECT doc_id, {X.SQL_COUNT} AS n_words, (sum({X.SQL_COUNT}) OVER (ORDER BY doc_id))::BIGINT - {X.SQL_COUNT} AS start_offset FROM documents",
}
