"""Evaluation statistics over labels, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.resample import bootstrap_rates, draw, sql_draws, sql_intervals
from ..plans.scratch import bounded, written
from ..sources.tables import table

Z = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    p, n = successes / total, total.cast("double")
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def wilson_by_stratum(spark, sf_dir):
    g = _labelled(spark, sf_dir).groupBy("lang", "source").agg(F.sum("quality").alias("successes"), F.count("quality").alias("total"))
    low, high = wilson(F.col("successes"), F.col("total"))
    return g.where("total > 0").select("lang", "source", "successes", "total", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def grouping_sets_rates(spark, sf_dir):
    g = _labelled(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("quality_rate"), F.round(F.avg("toxic"), 9).alias("toxic_rate"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "quality_rate", "toxic_rate")


def _predicted() -> Column:
    words = X.word_count(F.col("text"))
    junk = F.regexp_count(X.body(F.col("text")), F.lit(r"[#*$%&|<>]"))
    return ((words >= 20) & (10 * junk <= words)).cast("int")


_PRED = rf"CASE WHEN {X.SQL_COUNT} >= 20 AND 10 * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) <= {X.SQL_COUNT} THEN 1 ELSE 0 END"


def classification_report(spark, sf_dir):
    """Rule prediction against the quality label: per class precision, recall and F1."""
    d = _labelled(spark, sf_dir).select("quality", _predicted().alias("p"))
    one = d.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "quality", "p").groupBy("class").agg(
        F.count_if((F.col("quality") == F.col("class")) & (F.col("p") == F.col("class"))).alias("tp"),
        F.count_if(F.col("p") == F.col("class")).alias("predicted"), F.count_if(F.col("quality") == F.col("class")).alias("support"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)), 9)
    f1 = F.round(F.coalesce(2 * F.col("tp") / F.when(F.col("predicted") + F.col("support") > 0, F.col("predicted") + F.col("support")), F.lit(0.0)), 9)
    return one.select("class", "tp", "predicted", "support", ratio("tp", "predicted").alias("precision"), ratio("tp", "support").alias("recall"), f1.alias("f1"))


def review_agreement_kappa(spark, sf_dir):
    """Cohen's kappa of label and rule, per language; 1 where chance forces the agreement there is."""
    d = _labelled(spark, sf_dir).select("lang", F.col("quality").alias("a"), _predicted().alias("b"))
    g = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.sum("a").alias("a1"), F.sum("b").alias("b1"))
    n = F.col("n").cast("double")
    po = F.col("agree") / n
    pe = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    return g.select("lang", "n", "agree", F.round(F.when(F.abs(pe - 1) < 1e-9, F.when(F.abs(po - 1) < 1e-9, 1.0)).otherwise((po - pe) / (1 - pe)), 9).alias("kappa"))


def bootstrap_interval(spark, sf_dir):
    """Percentile bootstrap of the quality rate by language, 10,000 replicates over the counts."""
    c = _labelled(spark, sf_dir).groupBy("lang").agg(F.count("quality").alias("n"), F.sum("quality").alias("s")).where("n > 0")
    return bootstrap_rates(c, ["lang"])


def paired_difference(spark, sf_dir):
    """Matched arms: orders of one customer with high against low priority, mean price difference by segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    arm = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "a").otherwise("b")
    g = o.groupBy("o_custkey").agg(F.avg(F.when(arm == "a", F.col("o_totalprice"))).alias("a"), F.avg(F.when(arm == "b", F.col("o_totalprice"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    g = g.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return g.groupBy("c_mktsegment").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("a") - F.col("b")), 4).alias("mean_difference"), F.count_if(F.col("a") > F.col("b")).alias("wins"))


def event_latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", last).alias("state"), F.max_by("event_id", last).alias("event_id"), F.count("*").alias("events"))


def event_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(before.alias("before"), F.col("event_type").alias("after")).where("before IS NOT NULL").groupBy("before", "after").agg(F.count("*").alias("n"))


def candidate_taxonomy(spark, sf_dir):
    """How often an event repeats the current, the previous, the first, an older or no earlier type of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(
        "event_type", F.lag("event_type", 1).over(w).alias("p1"), F.lag("event_type", 2).over(w).alias("p2"), F.first("event_type").over(w).alias("p0"),
        F.row_number().over(w).alias("k"), F.row_number().over(same).alias("seen"),
    )
    t = F.col("event_type")
    kind = F.when(t == F.col("p1"), "CURRENT").when(t == F.col("p2"), "PREVIOUS").when(F.col("k") == 1, "NEVER_VALID").when(t == F.col("p0"), "INITIAL").when(F.col("seen") > 1, "OLDER").otherwise("NEVER_VALID")
    return e.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def turn_pairs(spark, sf_dir):
    """Each reply beside the turn before it."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("asked_by"), X.word_count(F.col("text")).alias("words"), F.lag(X.word_count(F.col("text"))).over(w).alias("asked_words"))
    return c.where("asked_by IS NOT NULL AND asked_by <> role")


def reconciliation(spark, sf_dir):
    """Documents and labels matched both ways."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    j = d.join(lab, F.col("doc_id") == F.col("label_id"), "full_outer")
    kind = F.when(F.col("doc_id").isNull(), "unexpected").when(F.col("label_id").isNull(), "missing").otherwise("matched")
    return j.groupBy(kind.alias("status"), F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


def range_bucket_audit(spark, sf_dir):
    """Quantities against half-open buckets by a range join on a fixed table of five rows."""
    b = spark.createDataFrame([("a", 0, 10), ("b", 10, 20), ("c", 20, 30), ("d", 30, 45), ("e", 45, 1000)], "bucket string, low int, high int")
    q = table(spark, sf_dir, "lineitem").select("l_quantity")
    j = q.join(F.broadcast(b), (F.col("l_quantity") >= F.col("low")) & (F.col("l_quantity") < F.col("high")))
    return j.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("mean"))


def grid_coverage(spark, sf_dir):
    """Cells of region x segment with their number of customers, empty cells included."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    segments = c.select("c_mktsegment").distinct()
    have = c.groupBy(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return r.crossJoin(F.broadcast(segments)).join(have, ["r_regionkey", "c_mktsegment"], "left").select("r_name", "c_mktsegment", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, macro F1 and the majority's share from (class, tp, predicted, support)."""
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return counts.agg(
        F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 9).alias("accuracy"), F.round(F.avg(F.when(support > 0, tp / support)), 9).alias("balanced_accuracy"),
        F.round(F.avg(ratio(2 * tp, predicted + support)), 9).alias("macro_f1"), F.round(F.max("support") / F.sum("support"), 9).alias("majority"),
    )


def classification_summary(spark, sf_dir):
    return summary_metrics(classification_report(spark, sf_dir))


def centroid_probe(spark, sf_dir):
    """Nearest-centroid probe of the embeddings' labels: centroids of the even vectors, tested on the odd ones.

    Centroids are as many as there are labels, checked before they are broadcast.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.where("vec_id % 2 = 0").groupBy("label", "k").agg(F.avg("x").alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
    c = bounded(written(c.withColumnRenamed("label", "guess"), "centroids"))
    far = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, b: a + b)
    t = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").crossJoin(c).groupBy("vec_id", "label").agg(F.min_by("guess", F.struct(F.round(far, 6).alias("d"), F.col("guess"))).alias("guess"))
    classes = t.select(F.explode(F.array("label", "guess")).alias("class")).distinct()
    hits = t.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("guess")).alias("tp"))
    made = t.groupBy(F.col("guess").alias("class")).agg(F.count("*").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return classes.join(hits, "class", "left").join(made, "class", "left").select("class", zero("tp"), zero("predicted"), zero("support"))


def centroid_probe_accuracy(spark, sf_dir):
    return summary_metrics(centroid_probe(spark, sf_dir))


def clustered_difference(spark, sf_dir, replicates: int = 2_000):
    """Difference of the quality rate between English and other documents of a source, sources resampled whole.

    One number a source is gathered; sources are the clusters and few beside documents.
    """
    d = _labelled(spark, sf_dir).groupBy("source").agg(F.avg(F.when(F.col("lang") == "en", F.col("quality"))).alias("a"), F.avg(F.when(F.col("lang") != "en", F.col("quality"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    v = d.agg(F.array_sort(F.collect_list(F.round(F.col("a") - F.col("b"), 9))).alias("v")).where("size(v) > 0").withColumn("n", F.size("v").cast("long"))
    r = v.select("v", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("r"))
    total = lambda index: F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0.0), lambda a, i: a + F.get(F.col("v"), index(i).cast("int")))
    r = r.select("n", (total(lambda i: draw(F.col("r"), i, F.col("n"))) / F.col("n")).alias("m"), (total(lambda i: i) / F.col("n")).alias("point"))
    return r.groupBy("n").agg(F.round(F.max("point"), 7).alias("difference"), F.round(F.percentile("m", 0.025), 7).alias("low"), F.round(F.percentile("m", 0.975), 7).alias("high"))


def relative_changes(spark, sf_dir):
    """Percentage change of the mean order price from one year to the next."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.avg("o_totalprice").alias("price"))
    return o.select("year", F.round(100 * (F.col("price") / F.lag("price").over(Window.orderBy("year")) - 1), 6).alias("change"))


QUERIES = {
    "classification_summary": classification_summary, "centroid_probe": centroid_probe, "centroid_probe_accuracy": centroid_probe_accuracy,
    "clustered_difference": clustered_difference, "relative_changes": relative_changes,
    "wilson_by_stratum": wilson_by_stratum, "grouping_sets_rates": grouping_sets_rates, "classification_report": classification_report,
    "review_agreement_kappa": review_agreement_kappa, "bootstrap_interval": bootstrap_interval, "paired_difference": paired_difference,
    "event_latest_state": event_latest_state, "event_transitions": event_transitions, "candidate_taxonomy": candidate_taxonomy,
    "turn_pairs": turn_pairs, "reconciliation_full_outer": reconciliation, "range_bucket_audit": range_bucket_audit, "grid_coverage": grid_coverage,
}
_L = "documents JOIN labels USING (doc_id)"
_W = f"round(({{s}} / n + {Z * Z / 2!r} / n {{sign}} {Z!r} * sqrt({{s}} / n * (1 - {{s}} / n) / n + {Z * Z / 4!r} / n / n)) / (1 + {Z * Z!r} / n), 9)"
_REPORT = f"WITH d AS (SELECT quality, {_PRED} AS p FROM {_L}), o AS (SELECT class, count(*) FILTER (quality = class AND p = class) AS tp, count(*) FILTER (p = class) AS predicted, count(*) FILTER (quality = class) AS support FROM d, (SELECT unnest([0, 1])::INTEGER AS class) GROUP BY class) SELECT class, tp, predicted, support, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 9) AS f1 FROM o"
_SUMMARY = "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(CASE WHEN support > 0 THEN tp / support END), 9) AS balanced_accuracy, round(avg(coalesce(2 * tp / nullif(predicted + support, 0), 0)), 9) AS macro_f1, round(max(support) / sum(support), 9) AS majority FROM ({c})"
_PROBE = """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS guess, k, avg(x) AS m FROM e WHERE vec_id % 2 = 0 GROUP BY ALL),
  f AS (SELECT vec_id, label, guess, round(sum((x - m) * (x - m)), 6) AS d FROM e JOIN m USING (k) WHERE vec_id % 2 = 1 GROUP BY ALL), t AS (SELECT vec_id, label, arg_min(guess, (d, guess)) AS guess FROM f GROUP BY ALL),
  n AS (SELECT DISTINCT unnest([label, guess]) AS class FROM t), c AS (SELECT class, count(*) FILTER (label = class AND guess = class) AS tp, count(*) FILTER (guess = class) AS predicted, count(*) FILTER (label = class) AS support FROM n, t GROUP BY class)"""
ORACLE_SQL = {
    "wilson_by_stratum": f"WITH g AS (SELECT lang, source, sum(quality)::BIGINT AS s, count(quality) AS n FROM {_L} GROUP BY ALL) SELECT lang, source, s AS successes, n AS total, {_W.format(s='s', sign='-')} AS low, {_W.format(s='s', sign='+')} AS high FROM g WHERE n > 0",
    "grouping_sets_rates": f"SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, round(avg(quality), 9) AS quality_rate, round(avg(toxic), 9) AS toxic_rate FROM {_L} GROUP BY CUBE (lang, source)",
    "classification_report": _REPORT,
    "classification_summary": _SUMMARY.format(c="SELECT class, tp, predicted, support FROM (" + _REPORT + ")"),
    "centroid_probe": _PROBE + " SELECT * FROM c",
    "centroid_probe_accuracy": _PROBE + ", k AS (SELECT * FROM c) " + _SUMMARY.format(c="SELECT * FROM k"),
    "clustered_difference": f"WITH d AS (SELECT source, avg(quality) FILTER (lang = 'en') AS a, avg(quality) FILTER (lang <> 'en') AS b FROM {_L} GROUP BY source), v AS (SELECT list_sort(list(round(a - b, 9))) AS v, count(*) AS n FROM d WHERE a IS NOT NULL AND b IS NOT NULL), "
    f"m AS (SELECT r, any_value(n) AS n, sum(v[drawn + 1]) / any_value(n) AS m, list_sum(any_value(v)) / any_value(n) AS point FROM ({sql_draws('SELECT * FROM v WHERE n > 0', 2_000)}) GROUP BY r) SELECT n, round(max(point), 7) AS difference, round(quantile_cont(m, 0.025), 7) AS low, round(quantile_cont(m, 0.975), 7) AS high FROM m GROUP BY n",
    "relative_changes": "SELECT year, round(100 * (p / lag(p) OVER (ORDER BY year) - 1), 6) AS change FROM (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS p FROM orders GROUP BY 1)",
    "review_agreement_kappa": f"WITH d AS (SELECT lang, quality AS a, {_PRED} AS b FROM {_L}), g AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) AS agree, sum(a)::DOUBLE AS a1, sum(b)::DOUBLE AS b1 FROM d GROUP BY lang), k AS (SELECT *, agree / n AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n::DOUBLE * n) AS pe FROM g) SELECT lang, n, agree, round(CASE WHEN abs(pe - 1) < 1e-9 THEN CASE WHEN abs(po - 1) < 1e-9 THEN 1.0 END ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM k",
    "bootstrap_interval": sql_intervals(f"SELECT lang, count(quality) AS n, sum(quality)::BIGINT AS s FROM {_L} GROUP BY lang HAVING count(quality) > 0", "lang"),
    "paired_difference": "WITH g AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS a, avg(o_totalprice) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS b FROM orders GROUP BY 1) SELECT c_mktsegment, count(*) AS pairs, round(avg(a - b), 4) AS mean_difference, count(*) FILTER (a > b) AS wins FROM g JOIN customer ON c_custkey = o_custkey WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "event_latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM events GROUP BY 1",
    "event_transitions": "SELECT before, event_type AS after, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY ALL",
    "candidate_taxonomy": "WITH e AS (SELECT event_type AS t, lag(event_type, 1) OVER w AS p1, lag(event_type, 2) OVER w AS p2, first_value(event_type) OVER w AS p0, row_number() OVER w AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT CASE WHEN t = p1 THEN 'CURRENT' WHEN t = p2 THEN 'PREVIOUS' WHEN k = 1 THEN 'NEVER_VALID' WHEN t = p0 THEN 'INITIAL' WHEN seen > 1 THEN 'OLDER' ELSE 'NEVER_VALID' END AS category, count(*) AS n FROM e GROUP BY 1",
    "turn_pairs": f"WITH c AS (SELECT conv_id, turn, role, lag(role) OVER w AS asked_by, {X.SQL_COUNT} AS words, lag({X.SQL_COUNT}) OVER w AS asked_words FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM c WHERE asked_by <> role",
    "reconciliation_full_outer": "SELECT CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS status, coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "range_bucket_audit": "SELECT CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 20 THEN 'b' WHEN l_quantity < 30 THEN 'c' WHEN l_quantity < 45 THEN 'd' ELSE 'e' END AS bucket, count(*) AS n, round(avg(l_quantity::DOUBLE), 6) AS mean FROM lineitem GROUP BY 1",
    "grid_coverage": "SELECT r_name, s.c_mktsegment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer c ON c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY ALL",
}
