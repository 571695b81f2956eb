"""Packed sequences, training schedules and pair attachment, over words as tokens.

A document's packed form is a start sign, its words and an end sign.  Schedules draw
chunks by hash order where a seeded shuffle was meant; the interleave of sources is
computed in closed form, so it needs no sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import written
from ..sources.tables import table
from .audits import SEED, hash_splits
from .similarity import running_offsets

CONTEXT = 1024
#: Documents that are packed into one stream, and the schedule's shape.
STREAM, BATCH, ACCUMULATION = "en", 4, 2
IGNORED = -100


def packed_index(docs: DataFrame) -> DataFrame:
    """(doc_id, split, tokens, start_offset): packed lengths and offsets inside each split.

    Offsets come in two levels (see ``running_offsets``), so no task sorts a split.
    """
    d = hash_splits(docs.select("doc_id", (X.word_count(F.col("text")) + 3).alias("tokens")), "doc_id")
    out = None
    for s in ("train", "validation", "test"):
        part = running_offsets(d.where(F.col("split") == s), "doc_id", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = packed_index(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "split", "tokens", "start_offset", F.ceil((F.col("tokens") - 1) / CONTEXT).alias("sequences"))


def packing_report(index: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Per split: documents, tokens, targets, sequences, slots, padding; all of it reconciles."""
    n = F.ceil((F.col("tokens") - 1) / context)
    g = index.groupBy("split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") - 1).alias("targets"), F.sum(n).alias("sequences"))
    slots = F.col("sequences") * context
    return g.select("*", slots.alias("slots"), (slots - F.col("targets")).alias("padding"), F.round(100.0 * (slots - F.col("targets")) / slots, 9).alias("padding_percentage"))


def packed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(packed_index(table(spark, sf_dir, "documents")))


def derived_schedule(spark: SparkSession, sf_dir: str, batch: int = 16, accumulation: int = 4) -> DataFrame:
    """Schedule arithmetic of the train split for each number of epochs under consideration."""
    r = packed_splits(spark, sf_dir).where("split = 'train'")
    r = r.withColumn("epochs", F.explode(F.array(F.lit(1), F.lit(5), F.lit(15))))
    micro = F.ceil(F.col("sequences") / batch)
    steps = F.ceil(micro / accumulation)
    capacity = steps * (batch * accumulation * CONTEXT)
    return r.select(
        F.col("epochs").cast("long").alias("epochs"), micro.alias("microbatches_per_epoch"), steps.alias("steps_per_epoch"), (steps * F.col("epochs")).alias("max_steps"),
        F.greatest(F.lit(1).cast("long"), F.bround(steps * F.col("epochs") * 0.05).cast("long")).alias("warmup_steps"), capacity.alias("capacity"), (capacity - F.col("slots")).alias("unused"),
    )


def samples(docs: DataFrame, context: int, excluded: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk, inputs, labels): arrays of ``context`` words, labels one ahead, padded.

    Excluded documents (doc_id) give none; padding is the empty word and a null label.
    """
    if excluded is not None:
        docs = docs.join(excluded, "doc_id", "left_anti")
    d = docs.select("doc_id", F.concat(F.array(F.lit("<|story|>"), F.lit("<|bos|>")), X.split_words(F.col("text")), F.array(F.lit("<|eos|>"))).alias("t"))
    d = d.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 2) / context).cast("int"))).alias("chunk"))
    have = F.least(F.lit(context), F.size("t") - 1 - F.col("chunk") * context)
    pad = lambda c, v: F.concat(c, F.array_repeat(v, context - have))
    inputs, labels = F.slice("t", F.col("chunk") * context + 1, have), F.slice("t", F.col("chunk") * context + 2, have)
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), have.cast("long").alias("targets"), pad(inputs, F.lit("")).alias("inputs"), pad(labels, F.lit(None).cast("string")).alias("labels"))


def sample_digests(spark: SparkSession, sf_dir: str, context: int = 64) -> DataFrame:
    """Digests of every training sample of the documents that are not toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    s = samples(table(spark, sf_dir, "documents"), context, toxic)
    sha = lambda c: F.sha2(F.array_join(c, " ", "<none>").cast("binary"), 256)
    return s.select("doc_id", "chunk", "targets", sha("inputs").alias("inputs"), sha("labels").alias("labels"))


def serialized_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and continuation of every document of two lines or more: boundary, targets, masked labels' digest."""
    parts = F.split(X.body(F.col("text")), "\n", 2)
    d = table(spark, sf_dir, "documents").where(F.size(parts) == 2).select("doc_id", X.split_words(parts[0]).alias("o"), X.split_words(parts[1]).alias("c")).where("size(o) > 0 AND size(c) > 0")
    boundary = F.size("o") + 2
    labels = F.concat(F.array_repeat(F.lit(str(IGNORED)), boundary - 1), F.col("c"), F.array(F.lit("<|eos|>")))
    return d.select("doc_id", boundary.cast("long").alias("boundary"), (F.size("c") + 1).cast("long").alias("targets"), (F.size("o") + F.size("c") + 3).cast("long").alias("tokens"), F.sha2(F.array_join(labels, " ").cast("binary"), 256).alias("labels"))


# Mixed schedule -----------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), (X.word_count(F.col("text")) + 2).alias("targets"))
    d = d.select("doc_id", "lang", "targets", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("targets") - 1) / CONTEXT))).alias("chunk"))
    return d.select("doc_id", "lang", "chunk", F.least(F.lit(CONTEXT).cast("long"), F.col("targets") - F.col("chunk") * CONTEXT).alias("targets"))


def hash_ranked(df: DataFrame, by: str, key: Column, name: str) -> DataFrame:
    """+ ``name``: rank from 0 of the row's hash inside its group, in two levels of hash digits."""
    h = df.withColumn("_h", F.sha2(key.cast("binary"), 256)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy(by, "_b").agg(F.count("*").alias("_c"))
    counts = counts.select(by, "_b", (F.sum("_c").over(Window.partitionBy(by).orderBy("_b")) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h")) - 1
    return h.withColumn("_r", inside).join(counts, [by, "_b"]).withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_h", "_b", "_r", "_before")


def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, k, doc_id, chunk, targets, ordinal): one epoch of each source's chunks in hash
    order, interleaved so that after n entries each source is near its share of n.

    The k-th chunk of a source with c chunks stands at (k + 1/2) / c of the way; ordinals
    rank these places, ties by source.  Two levels (cells of the way, and rows inside), so
    no task sorts all entries.
    """
    e = written(hash_ranked(_chunks(spark, sf_dir), "lang", F.concat_ws(":", F.lit(SEED), "doc_id", "chunk"), "k"), "chunks")
    n = e.groupBy("lang").agg(F.count("*").alias("c"))
    e = e.join(F.broadcast(n), "lang").withColumn("at", (F.col("k") * 2 + 1) / (F.col("c") * 2)).withColumn("cell", F.floor(F.col("at") * 1024))
    cells = e.groupBy("cell").agg(F.count("*").alias("m"))
    cells = cells.select("cell", (F.sum("m").over(Window.orderBy("cell")) - F.col("m")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("at", "lang")) - 1
    e = e.withColumn("i", inside).join(F.broadcast(cells), "cell")
    return e.select("lang", "k", "doc_id", "chunk", "targets", (F.col("i") + F.col("before")).cast("long").alias("ordinal"))


def mixed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal")
    return mixed_entries(spark, sf_dir).select(
        "ordinal", (F.floor(o / (BATCH * ACCUMULATION)) + 1).alias("optimizer_step"), (F.floor(o / BATCH) % ACCUMULATION).alias("microbatch"), (o % BATCH).alias("batch_position"),
        F.col("lang").alias("source"), "doc_id", (F.col("chunk") * CONTEXT).alias("relative_start"), F.col("targets").alias("valid_targets"),
    )


def schedule_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, targets and their share by source of the mixed schedule."""
    s = mixed_schedule(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("valid_targets").alias("valid_targets"), F.max("ordinal").alias("last"))
    total = F.sum("valid_targets").over(Window.partitionBy())
    return s.select("*", F.round(100.0 * F.col("valid_targets") / total, 9).alias("percentage"))


def allocated_targets(spark: SparkSession, sf_dir: str, share: float = 0.6) -> DataFrame:
    """(lang, k, capacity, take): a share of each source's targets dealt over its chunks in proportion.

    Cumulative rounding meets the total exactly and no chunk gets more than it holds.
    """
    e = _chunks(spark, sf_dir)
    e = hash_ranked(e, "lang", F.concat_ws(":", F.lit(SEED), "doc_id", "chunk"), "k").select("lang", "k", F.col("targets").alias("capacity"))
    block = F.floor(F.col("k") / 4096)
    sums = e.groupBy("lang", block.alias("block")).agg(F.sum("capacity").alias("s"))
    sums = sums.select("lang", "block", (F.sum("s").over(Window.partitionBy("lang").orderBy("block")) - F.col("s")).alias("before"))
    run = F.sum("capacity").over(Window.partitionBy("lang", "block").orderBy("k"))
    e = e.withColumn("block", block).withColumn("run", run).join(sums, ["lang", "block"])
    upto = lambda c: F.floor(c * F.lit(int(share * 1000)) / 1000)
    now = F.col("before") + F.col("run")
    return e.select("lang", "k", "capacity", (upto(now) - upto(now - F.col("capacity"))).cast("long").alias("take"))


# Pair attachment ----------------------------------------------------------------------


def attached(entries: DataFrame, spans: DataFrame, batch: int) -> DataFrame:
    """(ordinal, pair, worlds): pairs whose spans a chunk's targets touch, once a microbatch,
    at the first chunk that does.

    entries: ordinal, doc, start, targets.  spans: doc, pair, world, begin, end (positions
    in the document).  Both sides are cut into cells of CONTEXT positions and joined on
    (doc, cell), so no range join scans all pairs; a hit that shares several cells counts once.
    """
    low, high = F.col("start") + 1, F.col("start") + 1 + F.col("targets")
    e = entries.select("ordinal", "doc", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / CONTEXT), F.floor((high - 1) / CONTEXT))).alias("cell"))
    s = spans.select("doc", "pair", "world", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / CONTEXT), F.floor((F.col("end") - 1) / CONTEXT))).alias("cell"))
    hits = e.join(s, ["doc", "cell"]).where("begin < high AND end > low").select("ordinal", "pair", "world")
    hits = hits.groupBy(F.floor(F.col("ordinal") / batch).alias("micro"), "pair")
    return hits.agg(F.min("ordinal").alias("ordinal"), F.array_join(F.array_sort(F.collect_set("world")), ",").alias("worlds")).select("ordinal", "pair", "worlds")


def interval_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the mixed schedule against spans at every 700 words, worlds A and B in turn."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), X.word_count(F.col("text")).alias("n")).where("n > 20")
    spans = d.select("doc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 700))).alias("i"))
    spans = spans.select(
        "doc", F.concat_ws("-", "doc", F.floor(F.col("i") / 2).cast("string")).alias("pair"), F.when(F.col("i") % 2 == 0, "A").otherwise("B").alias("world"),
        (F.col("i") * 700).alias("begin"), F.least(F.col("n"), F.col("i") * 700 + 30).alias("end"),
    )
    e = mixed_schedule(spark, sf_dir).select("ordinal", F.col("doc_id").alias("doc"), F.col("relative_start").alias("start"), F.col("valid_targets").alias("targets"))
    return attached(e, spans, BATCH)


def replay_schedule(spark: SparkSession, sf_dir: str, epochs: int = 2, tuned: int = 20, replay: int = 114) -> DataFrame:
    """Two epochs of fixed numbers of tuning and replay batches, in hash order."""
    r = spark.range(epochs * (tuned + replay)).select((F.col("id") % (tuned + replay)).alias("i"), (F.floor(F.col("id") / (tuned + replay)) + 1).alias("epoch"))
    r = r.withColumn("source", F.when(F.col("i") < tuned, "sft").otherwise("replay")).withColumn("h", F.sha2(F.concat_ws(":", F.lit(9009), "epoch", "i").cast("binary"), 256))
    return r.select("epoch", F.row_number().over(Window.partitionBy("epoch").orderBy("h")).cast("long").alias("position"), "source")


QUERIES = {
    "packed_documents": packed_documents, "packed_splits": packed_splits, "derived_schedule": derived_schedule, "sample_digests": sample_digests,
    "serialized_examples": serialized_examples, "mixed_schedule": mixed_schedule, "schedule_accounting": schedule_accounting,
    "allocated_targets": allocated_targets, "interval_attach": interval_attach, "replay_schedule": replay_schedule,
}


def _sqls() -> dict[str, str]:
    from .audits import _SPLITS

    t = "coalesce(text, '')"
    index = f"WITH {_SPLITS}, i AS (SELECT doc_id, split, n + 3 AS tokens, (sum(n + 3) OVER (PARTITION BY split ORDER BY doc_id))::BIGINT - n - 3 AS start_offset, ceil((n + 2) / {CONTEXT})::BIGINT AS sequences FROM (SELECT doc_id, split, {X.SQL_COUNT} AS n FROM s))"
    report = f"p AS (SELECT split, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(tokens - 1)::BIGINT AS targets, sum(sequences)::BIGINT AS sequences, (sum(sequences) * {CONTEXT})::BIGINT AS slots FROM i GROUP BY split)"
    words = X.sql_split_words(t)
    chunks = f"c AS (SELECT doc_id, lang, chunk, least({CONTEXT}, n - chunk * {CONTEXT}) AS targets FROM (SELECT doc_id, coalesce(lang, 'none') AS lang, {X.SQL_COUNT} + 2 AS n, unnest(range(0, ({X.SQL_COUNT} + 1) // {CONTEXT} + 1)) AS chunk FROM documents))"
    mixed = (
        f"WITH {chunks}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id || ':' || chunk)) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM c), "
        f"m AS (SELECT *, row_number() OVER (ORDER BY (k * 2 + 1) / (n * 2), lang) - 1 AS ordinal FROM k), "
        f"s AS (SELECT ordinal, ordinal // {BATCH * ACCUMULATION} + 1 AS optimizer_step, (ordinal // {BATCH}) % {ACCUMULATION} AS microbatch, ordinal % {BATCH} AS batch_position, lang AS source, doc_id, chunk * {CONTEXT} AS relative_start, targets AS valid_targets FROM m)"
    )
    return {
        "packed_documents": f"{index} SELECT * FROM i",
        "packed_splits": f"{index}, {report} SELECT *, slots - targets AS padding, round(100.0 * (slots - targets) / slots, 9) AS padding_percentage FROM p",
        "derived_schedule": f"{index}, {report}, e AS (SELECT *, unnest([1, 5, 15])::BIGINT AS epochs, ceil(sequences / 16)::BIGINT AS m FROM p WHERE split = 'train'), f AS (SELECT *, ceil(m / 4)::BIGINT AS st FROM e) "
        f"SELECT epochs, m AS microbatches_per_epoch, st AS steps_per_epoch, st * epochs AS max_steps, greatest(1, round_even(st * epochs * 0.05::DOUBLE, 0))::BIGINT AS warmup_steps, st * {64 * CONTEXT} AS capacity, st * {64 * CONTEXT} - slots AS unused FROM f",
        "sample_digests": f"""WITH d AS (SELECT doc_id, ['<|story|>', '<|bos|>'] || {words} || ['<|eos|>'] AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), c AS (SELECT *, unnest(range(0, (len(t) - 2) // 64 + 1)) AS chunk FROM d),
          h AS (SELECT *, least(64, len(t) - 1 - chunk * 64) AS targets FROM c) SELECT doc_id, chunk, targets, sha256(array_to_string(t[chunk * 64 + 1:chunk * 64 + targets] || list_transform(range(64 - targets), lambda i: ''), ' ')) AS inputs,
          sha256(array_to_string(t[chunk * 64 + 2:chunk * 64 + 1 + targets] || list_transform(range(64 - targets), lambda i: '<none>'), ' ')) AS labels FROM h""",
        "serialized_examples": f"""WITH p AS (SELECT doc_id, split_part(t, chr(10), 1) AS a, substr(t, instr(t, chr(10)) + 1) AS b FROM (SELECT doc_id, {t} AS t FROM documents) WHERE contains(t, chr(10))), w AS (SELECT doc_id, {X.sql_split_words("a")} AS o, {X.sql_split_words("b")} AS c FROM p)
          SELECT doc_id, len(o) + 2 AS boundary, len(c) + 1 AS targets, len(o) + len(c) + 3 AS tokens, sha256(array_to_string(list_transform(range(len(o) + 1), lambda i: '-100') || c || ['<|eos|>'], ' ')) AS labels FROM w WHERE len(o) > 0 AND len(c) > 0""",
        "mixed_schedule": f"{mixed} SELECT * FROM s",
        "schedule_accounting": f"{mixed} SELECT source, count(*) AS chunks, sum(valid_targets)::BIGINT AS valid_targets, max(ordinal) AS last, round(100.0 * sum(valid_targets) / sum(sum(valid_targets)) OVER (), 9) AS percentage FROM s GROUP BY source",
        "allocated_targets": f"{mixed}, r AS (SELECT lang, k, targets AS capacity, (sum(targets) OVER (PARTITION BY lang ORDER BY k))::BIGINT AS run FROM k) SELECT lang, k, capacity, run * 600 // 1000 - (run - capacity) * 600 // 1000 AS take FROM r",
        "interval_attach": f"""{mixed}, d AS (SELECT doc_id AS doc, {X.SQL_COUNT} AS n FROM documents), x AS (SELECT doc, n, unnest(range(0, (n - 1) // 700 + 1)) AS i FROM d WHERE n > 20),
          sp AS (SELECT doc, doc || '-' || (i // 2) AS pair, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS world, i * 700 AS b, least(n, i * 700 + 30) AS e FROM x),
          h AS (SELECT ordinal, pair, world FROM s JOIN sp ON doc = doc_id AND b < relative_start + 1 + valid_targets AND e > relative_start + 1)
          SELECT min(ordinal) AS ordinal, pair, string_agg(DISTINCT world, ',' ORDER BY world) AS worlds FROM h GROUP BY ordinal // {BATCH}, pair""",
        "replay_schedule": "WITH r AS (SELECT i, e AS epoch, CASE WHEN i < 20 THEN 'sft' ELSE 'replay' END AS source FROM range(134) t(i), range(1, 3) u(e)) SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('9009:' || epoch || ':' || i)) AS position, source FROM r",
    }


ORACLE_SQL = _sqls()
