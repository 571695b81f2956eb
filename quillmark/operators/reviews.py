"""Blinded reviews: packets, resolution, pair consistency, intervals, strata, quotas and gates.

The registered queries read every labelled document as one reviewed generation: hash
digits of its id give model, scenario, trial, family, depth and world, and its labels the
reviewers' verdicts.  Counts are aggregated first; bootstraps work on the counts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as X
from ..functions.resample import SEED as BOOTSTRAP_SEED
from ..functions.resample import bootstrap_rates, draw, sql_draws, sql_intervals
from ..plans.scratch import written
from ..sources.tables import table
from .evaluation import wilson

TRIALS = ("greedy", "sampled:11337", "sampled:21337", "sampled:31337")
DIMENSIONS = ("overall", "split", "family", "depth", "family_depth")

_digit = lambda n: F.conv(F.substring(F.sha2(F.concat(F.lit("trial:"), F.col("doc_id").cast("string")).cast("binary"), 256), n, 1), 16, 10).cast("int")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as generations of two models in paired worlds, with two reviewers' labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), _digit(n) % len(values) + 1)
    good = F.when(F.col("quality") == 1, "consistent").otherwise("contradictory")
    return d.select(
        "doc_id", F.col("text"), pick(1, "baseline-a", "baseline-b").alias("model"), F.concat_ws("/", "source", (_digit(2) % 4).cast("string")).alias("scenario"), pick(3, *TRIALS).alias("trial"),
        F.col("lang").alias("split"), pick(4, "ownership", "location", "knowledge").alias("family"), pick(5, "1", "2", "3", "4+").alias("depth"), pick(6, "A", "B").alias("world"),
        good.alias("first"), F.when(_digit(7) == 0, "uncertain").when(_digit(7) == 1, "contradictory").otherwise(good).alias("second"), F.when(_digit(8) < 2, "uncertain").otherwise(good).alias("third"),
    )


def resolved(reviews: DataFrame) -> DataFrame:
    """+ disputed and label: equal and certain first labels stand, others take the adjudicator's."""
    disputed = (F.col("first") != F.col("second")) | (F.col("first") == "uncertain")
    return reviews.withColumn("disputed", disputed).withColumn("label", F.when(disputed, F.col("third")).otherwise(F.col("first")))


def paired(rows: DataFrame) -> DataFrame:
    """One row per (model, scenario, trial) with both worlds: strict success, unresolved, strata.

    A world's label is that of its smallest id; pairs without both worlds are left out.
    """
    keys = ["model", "scenario", "trial"]
    one = rows.groupBy(*keys, "world").agg(F.min_by(F.struct("label", "split", "family", "depth"), "doc_id").alias("r"))
    g = one.groupBy(*keys).agg(F.min("r.label").alias("low"), F.max("r.label").alias("high"), F.count("*").alias("worlds"), F.max(F.when(F.col("world") == "A", F.col("r"))).alias("a"))
    return g.where("worlds = 2").select(
        *keys, "a.split", "a.family", "a.depth", ((F.col("low") == "consistent") & (F.col("high") == "consistent")).alias("success"),
        ((F.col("low") == "uncertain") | (F.col("high") == "uncertain")).alias("unresolved"),
    )


def strata(df: DataFrame) -> DataFrame:
    """One row per row and dimension, with the dimension's value as stratum."""
    values = {"overall": F.lit("all"), "split": F.col("split"), "family": F.col("family"), "depth": F.col("depth"), "family_depth": F.concat_ws(":", "family", "depth")}
    return df.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("stratum")) for k, v in values.items()))))


def consistency(pairs: DataFrame, *more: str) -> DataFrame:
    """Per stratum: pairs, successes, strict rate, unresolved, rate of the resolved."""
    keys = [*more, "dimension", "stratum"]
    g = strata(pairs).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("success").alias("s"), F.count_if("unresolved").alias("unresolved"), F.count_if(F.col("success") & ~F.col("unresolved")).alias("rs"),
    )
    left = F.col("n") - F.col("unresolved")
    return g.select(*keys, "n", "s", "unresolved", F.round(F.col("s") / F.col("n"), 9).alias("rate"), F.when(left > 0, F.round(F.col("rs") / left, 9)).alias("resolved_rate"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(paired(resolved(generations(spark, sf_dir))), "pairs")


def review_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(generations(spark, sf_dir)).select("doc_id", "disputed", "label")


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency(_pairs(spark, sf_dir), "model")


def pair_consistency_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of the strict rate by model and the strata overall and family."""
    c = consistency(_pairs(spark, sf_dir), "model").where("dimension IN ('overall', 'family')")
    return bootstrap_rates(c.select("model", "dimension", "stratum", "n", "s"), ["model", "dimension", "stratum"])


def sampled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation of the strict rate over sampled trials, by model and stratum."""
    c = consistency(_pairs(spark, sf_dir).where("trial <> 'greedy'"), "model", "trial")
    return c.groupBy("model", "dimension", "stratum").agg(F.count("*").alias("seeds"), F.round(F.avg("rate"), 7).alias("mean"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 7).alias("deviation"))


def reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw agreement and kappa of the two first reviewers over three labels; kappa is 1 where both are forced to agree."""
    g = generations(spark, sf_dir)
    names = ("consistent", "contradictory", "uncertain")
    sums = [F.count_if((F.col(c) == n)).alias(f"{c}_{n}") for c in ("first", "second") for n in names]
    t = g.agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("second")).alias("agree"), *sums)
    chance = sum(F.col(f"first_{n}") * F.col(f"second_{n}") for n in names) / (F.col("n").cast("double") * F.col("n"))
    raw = F.col("agree") / F.col("n")
    kappa = F.when(F.abs(chance - 1) < 1e-9, F.when(F.abs(raw - 1) < 1e-9, 1.0)).otherwise((raw - chance) / (1 - chance))
    return t.select("n", F.round(raw, 9).alias("raw_agreement"), F.round(kappa, 9).alias("kappa"))


def model_difference(spark: SparkSession, sf_dir: str, replicates: int = 2_000) -> DataFrame:
    """Mean difference of the two models' success over matched blocks, with a bootstrap interval and the decision rule.

    Differences are -1, 0 or 1, so their counts stand for them: an index below the number
    of gains is a gain, one from the number of blocks without losses on a loss.
    """
    p = _pairs(spark, sf_dir).groupBy("scenario", "trial").agg(
        F.max(F.when(F.col("model") == "baseline-a", F.col("success").cast("int"))).alias("a"), F.max(F.when(F.col("model") == "baseline-b", F.col("success").cast("int"))).alias("b"),
    ).where("a IS NOT NULL AND b IS NOT NULL")
    c = p.agg(F.count("*").alias("n"), F.count_if(F.col("b") > F.col("a")).alias("gains"), F.count_if(F.col("b") < F.col("a")).alias("losses")).where("n > 0")
    r = c.select("n", "gains", "losses", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("r"))
    at = lambda i: draw(F.col("r"), i, F.col("n"))
    value = lambda i: F.when(at(i) < F.col("gains"), 1).when(at(i) >= F.col("n") - F.col("losses"), -1).otherwise(0)
    r = r.select("n", "gains", "losses", (F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0), lambda a, i: a + value(i)) / F.col("n")).alias("d"))
    g = r.groupBy("n", "gains", "losses").agg(F.round(F.percentile("d", 0.025), 9).alias("low"), F.round(F.percentile("d", 0.975), 9).alias("high"))
    point = F.round((F.col("gains") - F.col("losses")) / F.col("n"), 9)
    wide = F.col("high") - F.col("low") > 0.30
    return g.select("n", point.alias("difference"), "low", "high", (wide | ((F.col("low") <= 0) & (F.col("high") >= 0) & (F.abs(point) >= 0.10))).alias("next_stage"))


def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blinded packet: review ids and text digests, in hash order, without what would tell the model."""
    g = generations(spark, sf_dir)
    digest = F.sha2(X.body(F.col("text")).cast("binary"), 256)
    g = g.select(C.short_id("review-", 20, (F.col("doc_id").cast("string"), "string"), (digest, "string"), (F.col("model"), "string")).alias("review_id"), digest.alias("text_sha256"), F.size(X.split_words(F.col("text"))).cast("long").alias("words"))
    return g.withColumn("order_key", F.sha2(F.concat(F.lit(f"{BOOTSTRAP_SEED}:packet:"), "review_id").cast("binary"), 256))


def validated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of reviews: an evidence quote that the text lacks, a confidence out of 1 to 5, an adjudicator who saw no dispute."""
    g = resolved(generations(spark, sf_dir))
    quote = F.when(_digit(9) == 0, "nowhere to be found").when(X.body(F.col("text")) == "", "<EMPTY_OUTPUT>").otherwise(F.substring(X.body(F.col("text")), 1, 12))
    found = F.when(X.body(F.col("text")) == "", quote == "<EMPTY_OUTPUT>").otherwise(F.contains(X.body(F.col("text")), quote) & (X.strip(quote) != ""))
    g = g.select("doc_id", F.when(~found, "evidence_quote").alias("a"), F.when(~(_digit(10) % 7).between(1, 5), "confidence").alias("b"), F.when(~F.col("disputed") & (_digit(11) < 3), "unnecessary_adjudication").alias("c"))
    return g.select("doc_id", F.explode(F.array_compact(F.array("a", "b", "c"))).alias("problem"))


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of consistent labels by model with Wilson bounds, and whether a gate of 0.6 is met."""
    g = resolved(generations(spark, sf_dir)).groupBy("model").agg(F.count_if(F.col("label") == "consistent").alias("s"), F.count("*").alias("n"))
    low, high = wilson(F.col("s"), F.col("n"))
    return g.select("model", "s", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), (F.col("s") / F.col("n") >= 0.6).alias("gate"))


def text_diagnostics(spark: SparkSession, sf_dir: str, minimum: int = 150, maximum: int = 250) -> DataFrame:
    """Length class of every generation and the share of four facts (runs of three words of the opening) it repeats later."""
    w = F.col("w")
    g = generations(spark, sf_dir).select("doc_id", X.words(F.col("text")).alias("w"))
    facts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_join(F.slice(w, k * 3 + 1, F.lit(3)), " "))
    rest = F.concat(F.lit(" "), F.array_join(F.slice(w, 13, F.greatest(F.lit(1), F.size("w"))), " "), F.lit(" "))
    hits = F.size(F.filter(facts, lambda x: (x != "") & F.contains(rest, F.concat(F.lit(" "), x, F.lit(" ")))))
    n = F.size("w").cast("long")
    return g.select("doc_id", n.alias("words"), F.when(n < minimum, "short").when(n > maximum, "overlength").otherwise("compliant").alias("length"), F.round(hits / 4, 9).alias("fact_rate"))


def generation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of split x trial x depth with their generations; empty ones show as 0."""
    g = generations(spark, sf_dir)
    cells = g.select("split").distinct().withColumn("trial", F.explode(F.array(*map(F.lit, TRIALS)))).withColumn("depth", F.explode(F.array(*map(F.lit, ("1", "2", "3", "4+")))))
    have = g.groupBy("split", "trial", "depth").agg(F.count("*").alias("n"))
    return cells.join(have, ["split", "trial", "depth"], "left").select("split", "trial", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def balanced_selection(spark: SparkSession, sf_dir: str, seed: int = 77) -> DataFrame:
    """One scenario for every (split, family, depth) by hash rank, with the trial that the family's own order gives its depth."""
    g = generations(spark, sf_dir)
    rank = lambda *parts: F.sha2(F.concat_ws(":", F.lit(seed), *parts).cast("binary"), 256)
    cell = g.groupBy("split", "family", "depth").agg(F.min_by("scenario", rank(F.lit("scenario"), "split", "family", "depth", "scenario")).alias("scenario"))
    order = F.array_sort(F.array(*(F.struct(rank(F.lit("trial"), "split", "family", F.lit(t)).alias("h"), F.lit(t).alias("t")) for t in TRIALS)))
    at = F.when(F.col("depth") == "4+", 4).otherwise(F.col("depth").cast("int"))
    return cell.select("split", "family", "depth", "scenario", F.element_at(order, at)["t"].alias("trial"))


def structural_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (split, scenario, trial): size, models, worlds, and whether they are whole quartets."""
    g = generations(spark, sf_dir).groupBy("split", "scenario", "trial").agg(F.count("*").alias("rows"), F.countDistinct("model").alias("models"), F.countDistinct("world").alias("worlds"), F.countDistinct("model", "world").alias("cells"))
    return g.withColumn("whole", F.col("cells") == 4)


def quota_select(candidates: DataFrame, quotas: dict[str, dict[str, int]], seed: int, attempts: int = 200) -> DataFrame:
    """Candidates (id and the quota dimensions) that meet every marginal quota, by restarts of a greedy pass.

    Only as many of each combination of dimension values as the largest quota can matter,
    so what is collected is bounded by the quotas, not by the candidates.
    """
    names = list(quotas)
    most = max(sum(q.values()) for q in quotas.values())
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "id").cast("binary"), 256)))
    few = candidates.select("id", *names).withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
    for d in names:
        few = few.where(F.col(d).isin(list(quotas[d])))
    rows = [r.asDict() for r in few.collect()]
    wanted = sum(quotas[names[0]].values())
    for attempt in range(attempts):
        left, chosen = {d: dict(q) for d, q in quotas.items()}, []
        for r in sorted(rows, key=lambda x: hashlib.sha256(f"{seed}:{attempt}:{x['id']}".encode()).hexdigest()):
            if all(left[d][r[d]] > 0 for d in names):
                chosen.append((r["id"],))
                for d in names:
                    left[d][r[d]] -= 1
                if len(chosen) == wanted:
                    return candidates.sparkSession.createDataFrame(chosen, candidates.select("id").schema)
    raise ValueError(f"no selection meets the quotas within {attempts} attempts")


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent against contradictory labels overall, by family and by depth, and in world A alone."""
    g = resolved(generations(spark, sf_dir)).where("label <> 'uncertain'")
    x = F.col("label") == "consistent"
    s = strata(g).where("dimension IN ('overall', 'family', 'depth')").groupBy("dimension", "stratum")
    return s.agg(F.count_if(x).alias("x"), F.count_if(~x).alias("y"), F.round(F.avg(x.cast("int")), 9).alias("x_share"), F.count_if(x & (F.col("world") == "A")).alias("world_a_x"), F.count_if(~x & (F.col("world") == "A")).alias("world_a_y"))


def curriculum_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by every dimension in one pass, with the median and the 95th percentile of a generation's words."""
    g = generations(spark, sf_dir).withColumn("n", F.size(X.split_words(F.col("text"))).cast("long"))
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long")
    return strata(g).groupBy("dimension", "stratum").agg(F.count("*").alias("stories"), F.sum("n").alias("words"), F.median("n").alias("median"), p95.alias("p95"), F.max("n").alias("maximum"))


def forced_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World accuracy, joint success of both worlds, and ties, by stratum: a label counts as a preference, uncertain as a tie."""
    r = resolved(generations(spark, sf_dir)).groupBy("scenario", "trial", "model", "world").agg(F.min_by(F.struct("label", "split", "family", "depth"), "doc_id").alias("r")).select("scenario", "trial", "model", "world", "r.*")
    s = strata(r).groupBy("dimension", "stratum", "scenario", "trial", "model").agg(F.count("*").alias("worlds"), F.count_if(F.col("label") == "consistent").alias("right"), F.count_if(F.col("label") == "uncertain").alias("ties"))
    whole = F.col("worlds") == 2
    return s.groupBy("dimension", "stratum").agg(
        F.sum("worlds").alias("worlds"), F.round(F.sum("right") / F.sum("worlds"), 9).alias("world_accuracy"), F.count_if(whole).alias("pairs"),
        F.round(F.coalesce(F.count_if(whole & (F.col("right") == 2)) / F.when(F.count_if(whole) > 0, F.count_if(whole)), F.lit(0.0)), 9).alias("joint_success"), F.round(F.sum("ties") / F.sum("worlds"), 9).alias("tie_rate"),
    )


QUERIES = {
    "review_resolution": review_resolution, "review_pairs": review_pairs, "pair_consistency": pair_consistency, "pair_consistency_intervals": pair_consistency_intervals,
    "sampled_summary": sampled_summary, "reviewer_agreement": reviewer_agreement, "model_difference": model_difference, "review_packet": review_packet,
    "validated_reviews": validated_reviews, "review_scores": review_scores, "text_diagnostics": text_diagnostics, "generation_matrix": generation_matrix,
    "balanced_selection": balanced_selection, "structural_blocks": structural_blocks, "label_balance": label_balance, "curriculum_stats": curriculum_stats, "forced_choice": forced_choice,
}

_D = lambda n: f"('0x' || substr(sha256('trial:' || doc_id), {n}, 1))::INT"
_P = lambda n, *v: f"[{', '.join(repr(x) for x in v)}][{_D(n)} % {len(v)} + 1]"
_T = "coalesce(text, '')"
_GEN = f"""g0 AS MATERIALIZED (SELECT doc_id, text, {_P(1, 'baseline-a', 'baseline-b')} AS model, source || '/' || ({_D(2)} % 4) AS scenario, {_P(3, *TRIALS)} AS trial, lang AS split, {_P(4, 'ownership', 'location', 'knowledge')} AS family, {_P(5, '1', '2', '3', '4+')} AS depth, {_P(6, 'A', 'B')} AS world,
   CASE WHEN quality = 1 THEN 'consistent' ELSE 'contradictory' END AS first, {_D(7)} AS d7, {_D(8)} AS d8 FROM documents JOIN labels USING (doc_id)),
 g1 AS (SELECT *, CASE d7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'contradictory' ELSE first END AS second, CASE WHEN d8 < 2 THEN 'uncertain' ELSE first END AS third FROM g0),
 g AS MATERIALIZED (SELECT *, first <> second OR first = 'uncertain' AS disputed, CASE WHEN first <> second OR first = 'uncertain' THEN third ELSE first END AS label FROM g1)"""
_PAIR = f"""{_GEN}, o AS (SELECT model, scenario, trial, world, arg_min({{'label': label, 'split': split, 'family': family, 'depth': depth}}, doc_id) AS r FROM g GROUP BY ALL),
 p AS MATERIALIZED (SELECT model, scenario, trial, max(r.split) FILTER (world = 'A') AS split, max(r.family) FILTER (world = 'A') AS family, max(r.depth) FILTER (world = 'A') AS depth, bool_and(r.label = 'consistent') AS success, bool_or(r.label = 'uncertain') AS unresolved FROM o GROUP BY ALL HAVING count(*) = 2)"""
_STRATA = lambda t: f"SELECT *, unnest(['overall', 'split', 'family', 'depth', 'family_depth']) AS dimension, unnest(['all', split, family, depth, family || ':' || depth]) AS stratum FROM {t}"
_CONS = lambda keys, where="TRUE": f"SELECT {keys}, dimension, stratum, count(*) AS n, count(*) FILTER (success) AS s, count(*) FILTER (unresolved) AS unresolved, round(count(*) FILTER (success) / count(*), 9) AS rate, CASE WHEN count(*) FILTER (NOT unresolved) > 0 THEN round(count(*) FILTER (success AND NOT unresolved) / count(*) FILTER (NOT unresolved), 9) END AS resolved_rate FROM ({_STRATA('p')}) WHERE {where} GROUP BY ALL"
ORACLE_SQL = {
    "review_resolution": f"WITH {_GEN} SELECT doc_id, disputed, label FROM g",
    "review_pairs": f"WITH {_PAIR} SELECT * FROM p",
    "pair_consistency": f"WITH {_PAIR} {_CONS('model')}",
    "pair_consistency_intervals": f"WITH {_PAIR}, c AS (SELECT model, dimension, stratum, n, s FROM ({_CONS('model')}) WHERE dimension IN ('overall', 'family')) {sql_intervals('SELECT * FROM c', 'model, dimension, stratum')}",
    "sampled_summary": f"""WITH {_PAIR}, c AS ({_CONS('model, trial', "trial <> 'greedy'")}) SELECT model, dimension, stratum, count(*) AS seeds, round(avg(rate), 7) AS mean, round(coalesce(stddev_samp(rate), 0), 7) AS deviation FROM c GROUP BY ALL""",
    "reviewer_agreement": f"""WITH {_GEN}, t AS (SELECT count(*) AS n, count(*) FILTER (first = second) / count(*) AS raw, ({" + ".join(f"count(*) FILTER (first = '{x}') * count(*) FILTER (second = '{x}')" for x in ('consistent', 'contradictory', 'uncertain'))}) / (count(*)::DOUBLE * count(*)) AS chance FROM g)
      SELECT n, round(raw, 9) AS raw_agreement, round(CASE WHEN abs(chance - 1) < 1e-9 THEN CASE WHEN abs(raw - 1) < 1e-9 THEN 1.0 END ELSE (raw - chance) / (1 - chance) END, 9) AS kappa FROM t""",
    "model_difference": f"""WITH {_PAIR}, b AS (SELECT scenario, trial, max(success::INT) FILTER (model = 'baseline-a') AS a, max(success::INT) FILTER (model = 'baseline-b') AS b FROM p GROUP BY ALL), c AS (SELECT count(*) AS n, count(*) FILTER (b > a) AS gains, count(*) FILTER (b < a) AS losses FROM b WHERE a IS NOT NULL AND b IS NOT NULL),
      w AS (SELECT r, sum(CASE WHEN drawn < gains THEN 1 WHEN drawn >= n - losses THEN -1 ELSE 0 END) / any_value(n) AS d FROM ({sql_draws('SELECT * FROM c WHERE n > 0', 2_000)}) GROUP BY r), q AS (SELECT round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM w)
      SELECT n, round((gains - losses) / n, 9) AS difference, low, high, high - low > 0.30::DOUBLE OR (low <= 0 AND high >= 0 AND abs(round((gains - losses) / n, 9)) >= 0.10::DOUBLE) AS next_stage FROM c, q WHERE n > 0""",
    "review_packet": f"""WITH {_GEN}, p AS (SELECT 'review-' || left(sha256('["' || doc_id || '","' || sha256({_T}) || '","' || model || '"]'), 20) AS review_id, sha256({_T}) AS text_sha256, len({X.sql_split_words(_T)}) AS words FROM g) SELECT *, sha256('{BOOTSTRAP_SEED}:packet:' || review_id) AS order_key FROM p""",
    "validated_reviews": f"""WITH {_GEN}, q AS (SELECT doc_id, disputed, {_T} AS t, CASE WHEN {_D(9)} = 0 THEN 'nowhere to be found' WHEN {_T} = '' THEN '<EMPTY_OUTPUT>' ELSE left({_T}, 12) END AS q, {_D(10)} AS d10, {_D(11)} AS d11 FROM g)
      SELECT doc_id, 'evidence_quote' AS problem FROM q WHERE NOT (CASE WHEN t = '' THEN q = '<EMPTY_OUTPUT>' ELSE contains(t, q) AND {X.sql_strip("q")} <> '' END) UNION ALL SELECT doc_id, 'confidence' FROM q WHERE d10 % 7 NOT BETWEEN 1 AND 5 UNION ALL SELECT doc_id, 'unnecessary_adjudication' FROM q WHERE NOT disputed AND d11 < 3""",
    "review_scores": f"""WITH {_GEN}, c AS (SELECT model, count(*) FILTER (label = 'consistent') AS s, count(*) AS n FROM g GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, s / n AS p FROM c)
      SELECT model, s, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS high, p >= 0.6::DOUBLE AS gate FROM z""",
    "text_diagnostics": f"""WITH {_GEN}, w AS (SELECT doc_id, {X.SQL_WORDS} AS w FROM g), f AS (SELECT *, list_transform(range(4), lambda k: array_to_string(w[k * 3 + 1:k * 3 + 3], ' ')) AS f, ' ' || array_to_string(w[13:], ' ') || ' ' AS r FROM w)
      SELECT doc_id, len(w) AS words, CASE WHEN len(w) < 150 THEN 'short' WHEN len(w) > 250 THEN 'overlength' ELSE 'compliant' END AS length, round(len(list_filter(f, lambda x: x <> '' AND contains(r, ' ' || x || ' '))) / 4, 9) AS fact_rate FROM f""",
    "generation_matrix": f"WITH {_GEN}, c AS (SELECT split, trial, depth FROM (SELECT DISTINCT split FROM g), (SELECT unnest({list(TRIALS)}) AS trial), (SELECT unnest(['1', '2', '3', '4+']) AS depth)) SELECT split, trial, depth, count(doc_id) AS n FROM c LEFT JOIN g USING (split, trial, depth) GROUP BY ALL",
    "balanced_selection": f"""WITH {_GEN}, c AS (SELECT split, family, depth, arg_min(scenario, sha256('77:scenario:' || split || ':' || family || ':' || depth || ':' || scenario)) AS scenario FROM g GROUP BY ALL)
      SELECT split, family, depth, scenario, list_sort([{", ".join(f"sha256('77:trial:' || split || ':' || family || ':{t}') || '{t}'" for t in TRIALS)}])[CASE WHEN depth = '4+' THEN 4 ELSE depth::INT END][65:] AS trial FROM c""",
    "structural_blocks": f"WITH {_GEN} SELECT split, scenario, trial, count(*) AS rows, count(DISTINCT model) AS models, count(DISTINCT world) AS worlds, count(DISTINCT (model, world)) AS cells, count(DISTINCT (model, world)) = 4 AS whole FROM g GROUP BY ALL",
    "label_balance": f"""WITH {_GEN} SELECT dimension, stratum, count(*) FILTER (label = 'consistent') AS x, count(*) FILTER (label <> 'consistent') AS y, round(avg((label = 'consistent')::INT), 9) AS x_share, count(*) FILTER (label = 'consistent' AND world = 'A') AS world_a_x, count(*) FILTER (label <> 'consistent' AND world = 'A') AS world_a_y
      FROM ({_STRATA('g')}) WHERE label <> 'uncertain' AND dimension IN ('overall', 'family', 'depth') GROUP BY ALL""",
    "curriculum_stats": f"WITH {_GEN}, n AS (SELECT *, len({X.sql_split_words(_T)}) AS n FROM g) SELECT dimension, stratum, count(*) AS stories, sum(n)::BIGINT AS words, median(n) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS maximum FROM ({_STRATA('n')}) GROUP BY ALL",
    "forced_choice": f"""WITH {_GEN}, o AS (SELECT scenario, trial, model, world, arg_min(label, doc_id) AS label, arg_min(split, doc_id) AS split, arg_min(family, doc_id) AS family, arg_min(depth, doc_id) AS depth FROM g GROUP BY scenario, trial, model, world),
      s AS (SELECT dimension, stratum, scenario, trial, model, count(*) AS w, count(*) FILTER (label = 'consistent') AS r, count(*) FILTER (label = 'uncertain') AS t FROM ({_STRATA('o')}) GROUP BY ALL)
      SELECT dimension, stratum, sum(w)::BIGINT AS worlds, round(sum(r) / sum(w), 9) AS world_accuracy, count(*) FILTER (w = 2) AS pairs, round(coalesce(count(*) FILTER (w = 2 AND r = 2) / nullif(count(*) FILTER (w = 2), 0), 0), 9) AS joint_success, round(sum(t) / sum(w), 9) AS tie_rate FROM s GROUP BY ALL""",
}
