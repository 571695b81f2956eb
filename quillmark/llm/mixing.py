"""Mixing sources to target weights with a low-discrepancy schedule.

Method (DataFrame functions only)
---------------------------------
1. Sources in code-point order, null last, weigh 5, 2, 1, repeating.  Targets share the
   whole size by weight, stop at three times the source's size, and the excess is shared
   again: water-filling in closed form over the sources sorted by cap / weight.
2. Each source's documents are shuffled by a hash and laid end to end; the stream is cut
   into blocks of equal size.  A source's offsets come in two levels, sqrt(n) ranges of
   the hash and the rows inside each, so no task ever sorts a whole source.
3. Slot n gets the source in whose share of the cumulative weights the van der Corput
   point of n (its bits reversed) falls.  Slots are ranked per source, again in two
   levels; the k-th slot of a source takes its block k modulo its number of blocks.
4. A document's taken words are those of its parts of taken blocks.  A block is taken at
   most three times.

Everything derives from hashes and integer arithmetic, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACES, WORD, free_name, table, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block, and blocks that a source has at least (if it has so many words).
BLOCK, LEAST_BLOCKS = 1024, 1024
BITS = 40
CELLS = 4096
CHUNK = 1024
#: Sources up to this number are broadcast, if their names have that many characters in all
#: at most; beyond it the joins shuffle.
BROADCAST_SOURCES, BROADCAST_NAMES = 50_000, 10_000_000


def _sources(sizes: DataFrame) -> DataFrame:
    """One row per source: sid, source_size, n_docs, target, blocks, slots, and its share of slots."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid").asc())
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - full) / rest)
    s = s.withColumn("capped", F.col("cap") / F.col("weight") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("cap").cast("double")))
    s = s.withColumn("target", F.coalesce(target, F.lit(0.0)))
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK), F.least("source_size", F.lit(LEAST_BLOCKS)))
    s = s.withColumn("blocks", blocks.cast("long"))
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))
    s = s.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long"))
    upto = F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("slots").over(everything)
    scaled = lambda n: F.expr(f"CAST(CAST({n} AS DECIMAL(20,0)) * {1 << BITS} div total AS BIGINT)")
    s = s.withColumn("upto", upto).withColumn("total", F.greatest(total, F.lit(1))).withColumn("since", F.col("upto") - F.col("slots"))
    return s.withColumn("low", scaled("since")).withColumn("high", scaled("upto"))


def _block_start(j):
    """First word of block j: the first source_size % blocks blocks are one word longer."""
    base = F.expr("source_size div blocks")
    return j * base + F.least(j, F.expr("source_size % blocks"))


def _block_of(p: str):
    return F.expr(
        f"CASE WHEN {p} < (source_size % blocks) * (source_size div blocks + 1) THEN {p} div (source_size div blocks + 1) "
        f"ELSE source_size % blocks + ({p} - (source_size % blocks) * (source_size div blocks + 1)) div greatest(source_size div blocks, 1) END"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per row of ``docs``.

    taken is the number of words that the mix takes of it; size counts the text's words (null: 0).  A null source is a source of its own, last
    in order.  Documents without words are never taken; a mix without words takes
    nothing.  Repeated rows hold neighbouring places of the stream and count each for
    itself.  Null ids are allowed.  An empty table gives no rows; other columns are ignored.
    """
    return _mix(docs, id_col, text_col, source_col, False)


def mix_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mix`` with the column spans: (at, part, times) for each taken block of a document,
    its first word's place, its words, and how often the block is taken."""
    return _mix(docs, id_col, text_col, source_col, True)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, with_spans: bool) -> DataFrame:
    spark = docs.sparkSession
    sizes = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":mix")).cast("binary")).alias("key"),
    )
    sizes = written(sizes, "sizes")
    sources = written(_sources(sizes), "sources")
    n_sources, n_slots, n_names = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES and n_names <= BROADCAST_NAMES else (lambda df: df.hint("merge"))

    # Slots: van der Corput point -> source, by an equi-join on the point's leading bits.
    point = F.conv(F.reverse(F.lpad(F.bin("n"), BITS, "0")), 2, 10).cast("long")
    width = (1 << BITS) // CELLS
    cells = sources.where("slots > 0").select(
        "sid", "blocks", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell")
    )
    slots = (
        spark.range(n_slots)
        .select(F.col("id").alias("n"))
        .withColumn("x", point)
        .withColumn("cell", F.expr(f"x div {width}"))
        .join(small(cells), "cell")
        .where("x >= low AND x < high")
        .select("sid", "blocks", "n", F.expr(f"n div {CHUNK}").alias("chunk"))
    )
    in_chunk = slots.withColumn("k", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("n")) - 1)
    before = (
        slots.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
        .withColumn("before", F.sum("c").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("c")).drop("c")
    )
    ranked = in_chunk.join(before, ["sid", "chunk"]).withColumn("k", F.col("k") + F.col("before"))
    times = (
        ranked.where(F.expr(f"k div blocks < {MOST_REPEATS}"))
        .groupBy("sid", F.expr("k % blocks").alias("block")).agg(F.count("*").alias("times"))
    )

    # Documents: place in the source's shuffled stream, in two levels.
    facts = sources.select(
        F.col("source").alias("s_source"), "sid", "source_size", "n_docs", "target", F.greatest("blocks", F.lit(1)).alias("blocks")
    )
    placed = sizes.join(small(facts), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    ranges = F.ceil(F.sqrt("n_docs")).cast("long")
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.shiftright(leading * ranges, 32))
    sums = placed.groupBy("sid", "range").agg(F.sum("size").alias("c"))
    sums = sums.withColumn("base", F.sum("c").over(Window.partitionBy("sid").orderBy("range")) - F.col("c")).drop("c")
    inside = Window.partitionBy("sid", "range").orderBy("key", "id", "size")
    placed = placed.withColumn("rn", F.row_number().over(inside)).withColumn(
        "run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    placed = placed.join(sums, ["sid", "range"]).withColumn("p", F.col("base") + F.col("run"))
    placed = placed.withColumn("e", F.col("p") + F.col("size"))
    parts = placed.withColumn("l", F.expr("e - 1")).withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(_block_of("p"), _block_of("l"))))
    )
    overlap = F.least(F.col("e"), _block_start(F.col("block") + 1)) - F.greatest(F.col("p"), _block_start(F.col("block")))
    at = F.greatest(F.col("p"), _block_start(F.col("block"))) - F.col("p")
    parts = parts.select("id", "source", "size", "source_size", "target", "sid", "range", "rn", "block", overlap.alias("part"), at.alias("at"))
    taken = F.coalesce(F.sum(F.col("part") * F.col("times")), F.lit(0)).cast("long").alias("taken")
    found = parts.join(times, ["sid", "block"], "left").groupBy("id", "source", "size", "source_size", "target", "sid", "range", "rn")
    if not with_spans:
        return found.agg(taken).drop("sid", "range", "rn")
    span = F.when(F.col("times") > 0, F.struct("at", "part", "times"))
    return found.agg(taken, F.array_sort(F.collect_list(span)).alias("spans")).drop("sid", "range", "rn")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as the mix takes them: the words of a document that lie in blocks
    taken k times or more are its k-th row, so the rows of a document hold just the words
    that ``mix`` counts as taken.

    A document taken as a whole keeps its text as it is; of others the taken words stay
    with the white space before them, in order.  All other columns stay.  Documents
    without words give no row, nor do those that no taken block touches.  Of rows that
    repeat id, source and size each comes by the spans of the first; null ids are allowed.
    """
    of, from_, size, spans, nth = (free_name(docs, n) for n in ("mix_id", "mix_source", "mix_size", "mix_spans", "mix_nth"))
    plan = mix_spans(docs, id_col, text_col, source_col).where("taken > 0").groupBy("id", "source", "size")
    # The first of repeated rows, by what it takes; sizes tell texts apart.
    plan = plan.agg(F.min("spans").alias(spans)).withColumnsRenamed({"id": of, "source": from_, "size": size})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.withColumn(size + "_of", F.regexp_count(text, F.lit(WORD)).cast("long"))
    rows = counted.join(
        plan, docs[id_col].eqNullSafe(plan[of]) & docs[source_col].cast("string").eqNullSafe(plan[from_]) & (counted[size + "_of"] == plan[size])
    )
    rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(F.col(spans), lambda x: x["times"])).cast("int"))))
    mine = F.filter(F.col(spans), lambda x: x["times"] >= F.col(nth))
    whole = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["part"]) == F.col(size)
    words = F.regexp_extract_all(text, F.lit(f"{SPACES}*{WORD}"), F.lit(0))
    some = F.array_join(F.flatten(F.transform(mine, lambda x: F.slice(words, (x["at"] + 1).cast("int"), x["part"].cast("int")))), "")
    new = F.when(whole, text).otherwise(F.ltrim(some))
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM sizes GROUP BY source
), s1 AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, source_size * 3 AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s1
), s3 AS (SELECT *, cap / weight < level AS capped FROM s2
), s4 AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE
            ELSE least(weight * max(CASE WHEN NOT capped THEN level END) OVER (), cap::DOUBLE) END AS target,
         greatest(ceil(source_size / 1024), least(source_size, 1024))::BIGINT AS blocks
  FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size + 0.5)::BIGINT ELSE 0 END AS slots FROM s4
), s6 AS (
  SELECT *, sum(slots) OVER (ORDER BY sid)::HUGEINT AS upto, greatest(sum(slots) OVER (), 1)::HUGEINT AS total FROM s5
), src AS (
  SELECT *, ((upto - slots) * 1099511627776 // total)::BIGINT AS low, (upto * 1099511627776 // total)::BIGINT AS high,
         source_size // greatest(blocks, 1) AS base, source_size % greatest(blocks, 1) AS extra
  FROM s6
), n AS (
  SELECT unnest(range((SELECT sum(slots)::BIGINT FROM src))) AS n
), x AS (
  SELECT n, list_sum(list_transform(range(40), lambda i: ((n >> i) & 1) << (39 - i)))::BIGINT AS x FROM n
), ranked AS (
  SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY n) - 1 AS k
  FROM x JOIN src ON x >= low AND x < high
), times AS (
  SELECT sid, k % blocks AS block, count(*) AS times FROM ranked WHERE k // blocks < 3 GROUP BY ALL
), placed AS (
  SELECT doc_id, s.source, size, key, src.*  EXCLUDE (source),
         sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS p
  FROM sizes s JOIN src ON s.source IS NOT DISTINCT FROM src.source
), parts AS (
  SELECT *, unnest(range(
    CASE WHEN p < extra * (base + 1) THEN p // (base + 1) ELSE extra + (p - extra * (base + 1)) // base END,
    CASE WHEN p + size - 1 < extra * (base + 1) THEN (p + size - 1) // (base + 1) ELSE extra + (p + size - 1 - extra * (base + 1)) // base END + 1)) AS block
  FROM placed WHERE size > 0
), taken AS (
  SELECT sid, doc_id, p, sum((least(p + size, (block + 1) * base + least(block + 1, extra)) - greatest(p, block * base + least(block, extra))) * times)::BIGINT AS taken
  FROM parts JOIN times USING (sid, block) GROUP BY ALL
)
SELECT placed.doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed LEFT JOIN taken ON placed.sid = taken.sid AND placed.doc_id = taken.doc_id AND placed.p = taken.p AND size > 0
"""
