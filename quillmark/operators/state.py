"""State histories: transitions, carries, candidate taxonomies and decision results.

The queries read a document's lines as its events: a line's first three words are the
evidence, the length of its first word modulo four the state.  Histories are never
gathered: what a rule asks of one is a lag, a first value or the first place of a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import written
from ..sources.tables import table

# Distances at which a state is asked for again, and the order of categories.
CARRIES = (32, 64, 128, 256)
PRECEDENCE = ("CURRENT", "PREVIOUS", "INITIAL", "OLDER", "NEVER_VALID")
STATES = ("s0", "s1", "s2", "s3")


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, event, state, token_start, token_end, next_start, last): one row a non-blank line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("event", "line"))
    d = d.select("doc_id", F.col("event").cast("long").alias("event"), X.split_words(F.col("line")).alias("w"))
    d = d.select("doc_id", "event", F.size("w").cast("long").alias("n"), F.concat(F.lit("s"), (F.length(F.get("w", 0)) % len(STATES)).cast("string")).alias("state"))
    order = Window.partitionBy("doc_id").orderBy("event")
    start = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    last = F.lead("event").over(order).isNull()
    return d.select("doc_id", "event", "state", start.alias("token_start"), (start + F.least(F.lit(3).cast("long"), F.col("n"))).alias("token_end"), (start + F.col("n")).alias("boundary"), last.alias("last"))


def transitions(events: DataFrame, group: str = "doc_id", order: str = "event", state: str = "state") -> DataFrame:
    """+ pre_state (null for the first) and whether the state changed."""
    pre = F.lag(state).over(Window.partitionBy(group).orderBy(order))
    return events.withColumn("pre_state", pre).withColumn("changed", ~F.col("pre_state").eqNullSafe(F.col(state)))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transitions(line_events(spark, sf_dir))
    return e.select("doc_id", "event", "pre_state", F.col("state").alias("post_state"), "changed", F.col("token_end").alias("prediction_index"))


def carry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at fixed distances after a transition, up to the next event's first token."""
    e = line_events(spark, sf_dir).withColumn("distance", F.explode(F.array(*(F.lit(c).cast("long") for c in CARRIES))))
    return e.where("token_end + distance < boundary").select("doc_id", "event", "state", "distance", (F.col("token_end") + F.col("distance")).alias("prediction_index"))


def categories(value: Column, current: Column, previous: Column, initial: Column, first_place: Column, depth: Column, older_from: int = 1) -> Column:
    """Array of the categories of a value against a history of ``depth`` states, by precedence.

    ``first_place`` is the value's first place in the history (from 1, null: never), counting
    from ``older_from``: OLDER means places from there up to the third last.
    """
    tests = (
        value == current, (depth >= 2) & (value == previous), value == initial,
        (depth >= 3) & F.coalesce(first_place.between(older_from, depth - 2), F.lit(False)), F.coalesce(first_place > depth, F.lit(True)),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), c) for c, t in zip(PRECEDENCE, tests, strict=True))))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, depth, candidate, category, aliases, score, removed): every state as a candidate at every event.

    Scores derive from hashes; ``removed`` is the score with the latest evidence taken out.
    """
    e = line_events(spark, sf_dir).withColumn("depth", F.col("event") + 1)
    w = Window.partitionBy("doc_id").orderBy("depth")
    e = e.select("doc_id", "depth", "state", F.lag("state").over(w).alias("previous"), F.first("state").over(w).alias("initial"))
    firsts = e.groupBy("doc_id", F.col("state").alias("candidate")).agg(F.min("depth").alias("first_place"))
    c = e.withColumn("candidate", F.explode(F.array(*map(F.lit, STATES)))).join(firsts, ["doc_id", "candidate"], "left")
    aliases = categories(F.col("candidate"), F.col("state"), F.col("previous"), F.col("initial"), F.col("first_place"), F.col("depth"))
    h = F.sha2(F.concat_ws(":", "doc_id", "depth", "candidate").cast("binary"), 256)
    number = lambda at: F.conv(F.substring(h, at, 6), 16, 10).cast("long")
    bonus = F.when(F.col("candidate") == F.col("state"), 4_000_000).otherwise(0)
    return c.select(
        "doc_id", "depth", "candidate", F.get(aliases, 0).alias("category"), F.array_join(aliases, ",").alias("aliases"),
        (number(1) + bonus).alias("score"), (number(1) + F.floor(bonus / 4) - number(9) % 1000).alias("removed"),
    )


def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).drop("score", "removed")


def world_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of the best-scored candidate at each document's last event, with a middle history only as OLDER."""
    d = line_events(spark, sf_dir).withColumn("depth", F.col("event") + 1)
    w = Window.partitionBy("doc_id").orderBy("depth")
    last = d.select("doc_id", "depth", "state", "last", F.lag("state").over(w).alias("previous"), F.first("state").over(w).alias("initial")).where("last AND depth >= 2")
    # First place from the second event on: the middle of a history leaves out its first state.
    later = d.where("depth >= 2").groupBy("doc_id", F.col("state").alias("candidate")).agg(F.min("depth").alias("place"))
    ever = d.groupBy("doc_id", F.col("state").alias("candidate")).agg(F.min("depth").alias("ever"))
    c = last.withColumn("candidate", F.explode(F.array(*map(F.lit, STATES))))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "doc_id", "depth", "candidate").cast("binary"), 256), 1, 6), 16, 10).cast("long")
    best = c.groupBy("doc_id", "depth", "state", "previous", "initial").agg(F.max_by("candidate", F.struct(h.alias("h"), F.col("candidate"))).alias("candidate"))
    best = best.join(later, ["doc_id", "candidate"], "left").join(ever, ["doc_id", "candidate"], "left")
    middle = F.coalesce(F.col("place").between(2, F.col("depth") - 2), F.lit(False))
    v = F.col("candidate")
    name = F.when(v == F.col("state"), "CURRENT").when(v == F.col("previous"), "PREVIOUS").when(v == F.col("initial"), "INITIAL").when(middle, "OLDER").when(F.col("ever").isNull(), "NEVER_VALID").otherwise("OTHER_UNRESOLVED")
    bucket = F.when(F.col("depth") <= 3, F.col("depth").cast("string")).otherwise("4+")
    return best.select("doc_id", "depth", bucket.alias("depth_bucket"), v.alias("selected"), name.alias("category"))


def decision_results(d: DataFrame) -> DataFrame:
    """One row a decision: what is selected, whether it is current, margins of the current candidate.

    Ties go to the first candidate by name.  A margin is null where no other candidate has the category.
    """
    current = F.max(F.when(F.col("category") == "CURRENT", F.col("score")))
    others = lambda c, s="score": F.max(F.when((F.col("category") != "CURRENT") & F.contains(F.concat(F.lit(","), F.col("aliases"), F.lit(",")), F.lit(f",{c},")), F.col(s)))
    # Of equal scores the smallest name: names are s0 to s3.
    pick = F.struct(F.col("score"), (-F.substring("candidate", 2, 1).cast("int")).alias("first"))
    g = d.groupBy("doc_id", "depth").agg(
        F.max_by("candidate", pick).alias("selected"), F.max_by("category", pick).alias("selected_category"), F.max_by("aliases", pick).alias("selected_aliases"),
        current.alias("current_score"), F.max(F.when(F.col("category") != "CURRENT", F.col("score"))).alias("best_other"),
        F.max(F.when(F.col("category") == "CURRENT", F.col("removed"))).alias("current_removed"), F.max(F.when(F.col("category") != "CURRENT", F.col("removed"))).alias("best_other_removed"),
        *((current - others(c)).alias(f"margin_{c.lower()}") for c in PRECEDENCE[1:]),
    )
    return g.withColumn("correct", F.col("selected_category") == "CURRENT")


def decision_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_results(decisions(spark, sf_dir)).drop("selected_aliases")


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, category rates, alias rates and mean margins, overall and by depth bucket."""
    r = decision_results(decisions(spark, sf_dir))
    bucket = F.when(F.col("depth") <= 3, F.col("depth").cast("string")).otherwise("4+")
    r = r.withColumn("stratum", F.explode(F.array(F.lit("all"), bucket)))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    alias = lambda c: F.contains(F.concat(F.lit(","), F.col("selected_aliases"), F.lit(",")), F.lit(f",{c},"))
    return r.groupBy("stratum").agg(
        F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"), *(rate(F.col("selected_category") == c).alias(f"rate_{c.lower()}") for c in PRECEDENCE),
        *(rate(alias(c)).alias(f"alias_{c.lower()}") for c in PRECEDENCE), *(F.round(F.avg(f"margin_{c.lower()}"), 6).alias(f"margin_{c.lower()}") for c in PRECEDENCE[1:]),
        *(F.count_if(F.col(f"margin_{c.lower()}").isNull()).alias(f"unavailable_{c.lower()}") for c in PRECEDENCE[1:]),
    )


def depth_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents reach each depth bucket."""
    m = line_events(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("depth"))
    counts = m.agg(F.count("*").alias("all"), *(F.count_if(F.col("depth") >= k).alias(b) for k, b in ((1, "1"), (2, "2"), (3, "3"), (4, "4+"))))
    u = counts.unpivot("all", ["1", "2", "3", "4+"], "bucket", "available")
    return u.select("bucket", "available", (F.col("all") - F.col("available")).alias("unavailable"), F.when(F.col("available") > 0, "available").otherwise("unavailable").alias("status"))


def margin_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed margins with and without the latest evidence, and how often they shrink."""
    r = decision_results(decisions(spark, sf_dir))
    r = r.select((F.col("current_score") - F.col("best_other")).alias("before"), (F.col("current_removed") - F.col("best_other_removed")).alias("after"))
    return r.agg(
        F.count("*").alias("n"), F.round(F.avg("before"), 6).alias("mean_full"), F.round(F.avg("after"), 6).alias("mean_removed"),
        F.round(F.avg(F.abs("before") - F.abs("after")), 6).alias("mean_collapse"), F.round(F.avg(F.when(F.abs("after") < F.abs("before"), 1.0).otherwise(0.0)), 9).alias("collapse_rate"),
    )


def switch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the choice at an event switches when the scores of the event before take its place."""
    r = written(decision_results(decisions(spark, sf_dir)).select("doc_id", "depth", "selected", "correct"), "results")
    other = r.select("doc_id", (F.col("depth") + 1).alias("depth"), F.col("selected").alias("swapped"))
    j = r.join(other, ["doc_id", "depth"])
    return j.groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("selected") != F.col("swapped"), 1.0).otherwise(0.0)), 9).alias("switch_rate"))


def state_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which declared state kinds an event stream reconstructs, per user: a predicate over its events each."""
    e = table(spark, sf_dir, "events")
    low, high = F.col("value") < 20, F.col("value") > 60
    g = e.groupBy("user_id").agg(
        F.count("*").alias("events"), (F.countDistinct("event_type") >= 3).alias("identity"), (F.max(low) & F.max(high)).alias("knowledge"),
        (F.min_by("event_type", F.struct("ts", "event_id")) != F.max_by("event_type", F.struct("ts", "event_id"))).alias("movement"),
        (F.max_by("value", F.struct("ts", "event_id")) >= F.min_by("value", F.struct("ts", "event_id"))).alias("fulfilled"),
    )
    return g


def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the current candidate among all, its margin to the best other, and whether it is first."""
    d = decisions(spark, sf_dir)
    own = F.max(F.when(F.col("category") == "CURRENT", F.col("score"))).over(Window.partitionBy("doc_id", "depth"))
    d = d.withColumn("own", own)
    g = d.groupBy("doc_id", "depth").agg((F.count_if((F.col("category") != "CURRENT") & (F.col("score") > F.col("own"))) + 1).alias("rank"), (F.max("own") - F.max(F.when(F.col("category") != "CURRENT", F.col("score")))).alias("margin"))
    return g.select("doc_id", "depth", "rank", "margin", (F.col("rank") == 1).alias("top1"))


QUERIES = {
    "state_transitions": state_transitions, "carry_rows": carry_rows, "candidate_decisions": candidate_decisions, "world_choices": world_choices,
    "decision_results": decision_result_rows, "decision_summary": decision_summary, "depth_availability": depth_availability,
    "margin_collapse": margin_collapse, "switch_audit": switch_audit, "state_semantics": state_semantics, "score_ranks": score_ranks,
}

_EVENTS = f"""WITH l AS (SELECT doc_id, unnest(range(len(l))) AS event, unnest(l) AS x FROM (SELECT doc_id, {X.SQL_LINES} AS l FROM documents)), w AS (SELECT doc_id, event, {X.sql_split_words("x")} AS w FROM l),
  e AS MATERIALIZED (SELECT doc_id, event, 's' || (length(w[1]) % 4) AS state, len(w) AS n, (sum(len(w)) OVER o)::BIGINT - len(w) AS token_start, lead(event) OVER (PARTITION BY doc_id ORDER BY event) IS NULL AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY event)),
  h AS MATERIALIZED (SELECT *, event + 1 AS depth, lag(state) OVER o AS previous, first_value(state) OVER o AS initial FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY event))"""
_TESTS = ("candidate = state", "depth >= 2 AND candidate = previous", "candidate = initial", "depth >= 3 AND coalesce(first_place <= depth - 2, FALSE)", "coalesce(first_place > depth, TRUE)")
_DECISIONS = f"""{_EVENTS}, f AS (SELECT doc_id, state AS candidate, min(depth) AS first_place FROM h GROUP BY ALL), x AS (SELECT h.*, unnest(['s0', 's1', 's2', 's3']) AS candidate FROM h), y AS (SELECT x.*, first_place FROM x LEFT JOIN f USING (doc_id, candidate)),
  a AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in zip(PRECEDENCE, _TESTS, strict=True))}], lambda z: z IS NOT NULL) AS al, sha256(doc_id || ':' || depth || ':' || candidate) AS hx, CASE WHEN candidate = state THEN 4000000 ELSE 0 END AS bonus FROM y),
  d AS MATERIALIZED (SELECT doc_id, depth, candidate, al[1] AS category, array_to_string(al, ',') AS aliases, ('0x' || substr(hx, 1, 6))::BIGINT + bonus AS score, ('0x' || substr(hx, 1, 6))::BIGINT + bonus // 4 - ('0x' || substr(hx, 9, 6))::BIGINT % 1000 AS removed FROM a)"""
_OTHER = lambda c: f"max(score) FILTER (category <> 'CURRENT' AND contains(',' || aliases || ',', ',{c},'))"
_RESULTS = f"""{_DECISIONS}, r AS MATERIALIZED (SELECT doc_id, depth, arg_max(candidate, (score, -substr(candidate, 2, 1)::INT)) AS selected, arg_max(category, (score, -substr(candidate, 2, 1)::INT)) AS selected_category, arg_max(aliases, (score, -substr(candidate, 2, 1)::INT)) AS selected_aliases,
  max(score) FILTER (category = 'CURRENT') AS current_score, max(score) FILTER (category <> 'CURRENT') AS best_other, max(removed) FILTER (category = 'CURRENT') AS current_removed, max(removed) FILTER (category <> 'CURRENT') AS best_other_removed,
  {", ".join(f"max(score) FILTER (category = 'CURRENT') - {_OTHER(c)} AS margin_{c.lower()}" for c in PRECEDENCE[1:])} FROM d GROUP BY ALL)"""
_BUCKET = "CASE WHEN depth <= 3 THEN depth::VARCHAR ELSE '4+' END"
_rate = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END), 9)"
ORACLE_SQL = {
    "state_transitions": f"{_EVENTS} SELECT doc_id, event, previous AS pre_state, state AS post_state, previous IS DISTINCT FROM state AS changed, token_start + least(3, n) AS prediction_index FROM h",
    "carry_rows": f"{_EVENTS}, c AS (SELECT *, token_start + least(3, n) AS token_end, unnest({list(CARRIES)})::BIGINT AS distance FROM e) SELECT doc_id, event, state, distance, token_end + distance AS prediction_index FROM c WHERE token_end + distance < token_start + n",
    "candidate_decisions": f"{_DECISIONS} SELECT doc_id, depth, candidate, category, aliases FROM d",
    "world_choices": f"""{_EVENTS}, x AS (SELECT *, unnest(['s0', 's1', 's2', 's3']) AS candidate FROM h WHERE last AND depth >= 2), b AS (SELECT doc_id, depth, state, previous, initial, arg_max(candidate, (('0x' || substr(sha256(doc_id || ':' || depth || ':' || candidate), 1, 6))::BIGINT, candidate)) AS v FROM x GROUP BY ALL),
      p AS (SELECT doc_id, state AS v, min(depth) FILTER (depth >= 2) AS place, min(depth) AS ever FROM h GROUP BY ALL)
      SELECT b.doc_id, depth, {_BUCKET} AS depth_bucket, v AS selected, CASE WHEN v = state THEN 'CURRENT' WHEN v = previous THEN 'PREVIOUS' WHEN v = initial THEN 'INITIAL' WHEN place BETWEEN 2 AND depth - 2 THEN 'OLDER' WHEN ever IS NULL THEN 'NEVER_VALID' ELSE 'OTHER_UNRESOLVED' END AS category FROM b LEFT JOIN p USING (doc_id, v)""",
    "decision_results": f"{_RESULTS} SELECT * EXCLUDE (selected_aliases), selected_category = 'CURRENT' AS correct FROM r",
    "decision_summary": f"{_RESULTS}, s AS (SELECT *, unnest(['all', {_BUCKET}]) AS stratum FROM r) SELECT stratum, count(*) AS n, {_rate(chr(115) + 'elected_category = ' + chr(39) + 'CURRENT' + chr(39))} AS accuracy, "
    + ", ".join(f"{_rate(f'''selected_category = '{c}' ''')} AS rate_{c.lower()}" for c in PRECEDENCE) + ", " + ", ".join(f"{_rate(f'''contains(',' || selected_aliases || ',', ',{c},')''')} AS alias_{c.lower()}" for c in PRECEDENCE) + ", "
    + ", ".join(f"round(avg(margin_{c.lower()}), 6) AS margin_{c.lower()}" for c in PRECEDENCE[1:]) + ", " + ", ".join(f"count(*) FILTER (margin_{c.lower()} IS NULL) AS unavailable_{c.lower()}" for c in PRECEDENCE[1:]) + " FROM s GROUP BY stratum",
    "depth_availability": f"{_EVENTS}, m AS (SELECT doc_id, count(*) AS depth FROM e GROUP BY 1), b AS (SELECT unnest(['1', '2', '3', '4+']) AS bucket, unnest([1, 2, 3, 4]) AS k) SELECT bucket, count(*) FILTER (depth >= k) AS available, count(*) FILTER (depth < k) AS unavailable, CASE WHEN count(*) FILTER (depth >= k) > 0 THEN 'available' ELSE 'unavailable' END AS status FROM m, b GROUP BY bucket",
    "margin_collapse": f"{_RESULTS}, m AS (SELECT current_score - best_other AS b, current_removed - best_other_removed AS a FROM r) SELECT count(*) AS n, round(avg(b), 6) AS mean_full, round(avg(a), 6) AS mean_removed, round(avg(abs(b) - abs(a)), 6) AS mean_collapse, {_rate('abs(a) < abs(b)')} AS collapse_rate FROM m",
    "switch_audit": f"{_RESULTS} SELECT x.selected_category = 'CURRENT' AS correct, count(*) AS n, {_rate('x.selected <> y.selected')} AS switch_rate FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.depth = y.depth + 1 GROUP BY 1",
    "state_semantics": "SELECT user_id, count(*) AS events, count(DISTINCT event_type) >= 3 AS identity, bool_or(value < 20) AND bool_or(value > 60) AS knowledge, arg_min(event_type, (ts, event_id)) <> arg_max(event_type, (ts, event_id)) AS movement, arg_max(value, (ts, event_id)) >= arg_min(value, (ts, event_id)) AS fulfilled FROM events GROUP BY 1",
    "score_ranks": f"{_DECISIONS}, o AS (SELECT doc_id, depth, max(score) FILTER (category = 'CURRENT') AS own FROM d GROUP BY ALL) SELECT doc_id, depth, count(*) FILTER (category <> 'CURRENT' AND score > own) + 1 AS rank, max(own) - max(score) FILTER (category <> 'CURRENT') AS margin, count(*) FILTER (category <> 'CURRENT' AND score > own) = 0 AS top1 FROM d JOIN o USING (doc_id, depth) GROUP BY doc_id, depth",
}
