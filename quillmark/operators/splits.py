"""Grouped and anchored splits, exact split counts, and audits of assignments.

Greedy rules take the groups one after another and keep only the three split totals, so
they run as one streaming task over the sorted (group, size) rows: documents never pass
through it, and its memory does not grow.  Random shuffles become hash orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import bounded, written
from ..sources.tables import table
from .audits import SEED, hash_splits

SPLITS = ("train", "validation", "test")
SHARES = (0.85, 0.075, 0.075)


def _hash(seed: int, column: str):
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")).cast("binary"), 256)


def greedy(groups: DataFrame, targets: tuple[float, ...], start: tuple[int, ...], rule: str, order: list) -> DataFrame:
    """(grp, size, split): groups in ``order``, each to the split that the rule prefers.

    ``least_filled``: least total against target; ``least_deficit``: smallest sum of squared
    relative deviations from the targets once the group is in.  Ties go by split order.
    """

    def pick(total: list[int], size: int) -> int:
        if rule == "least_filled":
            return min(range(3), key=lambda k: (total[k] / max(1.0, targets[k]), k))
        gap = lambda k: sum(((total[j] + (size if j == k else 0) - targets[j]) / targets[j]) ** 2 for j in range(3))
        return min(range(3), key=lambda k: (gap(k), k))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = list(start)
        for f in frames:
            out = []
            for size in f["size"].tolist():
                k = pick(total, size)
                total[k] += size
                out.append(SPLITS[k])
            yield f.assign(split=out)

    kind = groups.schema["grp"].dataType.simpleString()
    # One task in order; its rows are groups, not documents.
    return groups.select("grp", "size", *(c.alias(f"_o{i}") for i, c in enumerate(order))).orderBy(*(f"_o{i}" for i in range(len(order)))).coalesce(1).select("grp", "size").mapInPandas(run, f"grp {kind}, size long, split string")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("grp"), X.word_count(F.col("text")).alias("n_words")
    )


def token_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in hash order, each to the split with the least words against its share."""
    d = written(_weights(spark, sf_dir), "weights")
    total = d.agg(F.sum("n_words")).first()[0] or 0
    groups = d.groupBy("grp").agg(F.sum("n_words").alias("size"))
    return greedy(groups, tuple(total * s for s in SHARES), (0, 0, 0), "least_filled", [_hash(SEED, "grp")])


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, documents, split, anchored, conflict): groups with labelled documents follow the
    majority of these documents' own hash splits; the others, largest first, fill the deficits."""
    d = _weights(spark, sf_dir).select("doc_id", "grp")
    old = hash_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").join(table(spark, sf_dir, "labels").where(F.col("doc_id") % 40 < 20).select("doc_id").distinct(), "doc_id", "left_semi")
    d = d.join(old, "doc_id", "left")
    votes = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    g = written(d.groupBy("grp").agg(F.count("*").alias("size"), *votes), "groups")
    best = F.greatest(*SPLITS)
    majority = F.when(F.col("train") == best, "train").when(F.col("validation") == best, "validation").otherwise("test")
    conflict = sum((F.col(s) > 0).cast("int") for s in SPLITS) > 1
    fixed = written(g.where(best > 0).select("grp", "size", majority.alias("split"), F.lit(True).alias("anchored"), conflict.alias("conflict")), "anchored")
    total = g.agg(F.sum("size")).first()[0] or 0
    aims = [round(total * SHARES[0]), round(total * SHARES[1])]
    aims.append(total - sum(aims))
    have = {r["split"]: r["n"] for r in fixed.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    rest = greedy(g.where(best == 0), tuple(map(float, aims)), tuple(have.get(s, 0) for s in SPLITS), "least_deficit", [-F.col("size"), _hash(SEED, "grp")])
    rest = rest.select("grp", "size", "split", F.lit(False).alias("anchored"), F.lit(False).alias("conflict"))
    return fixed.union(rest).withColumnRenamed("size", "documents")


def balanced_new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, documents, split): documents with a label keep their hash split; groups of the others fill what is left."""
    d = _weights(spark, sf_dir).select("doc_id", "grp")
    seeds = table(spark, sf_dir, "labels").select("doc_id").distinct()
    kept = hash_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").join(seeds, "doc_id", "left_semi")
    total = d.count()
    aims = [round(total * SHARES[0]), round(total * SHARES[1])]
    aims.append(total - sum(aims))
    have = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.count("*").alias("n")).collect()}
    more = tuple(float(max(1, a - have.get(s, 0))) for a, s in zip(aims, SPLITS, strict=True))
    new = d.join(seeds, "doc_id", "left_anti").groupBy("grp").agg(F.count("*").alias("size"))
    return greedy(new, more, (0, 0, 0), "least_deficit", [-F.col("size"), _hash(SEED, "grp")]).withColumnRenamed("size", "documents")


def subset(sizes: list[int], target: int) -> list[int] | None:
    """Indices of a subset with the given sum, or None: the first that reaches each sum, in order."""
    made: dict[int, tuple[int, int] | None] = {0: None}  # sum -> (last index, sum before)
    for i, n in enumerate(sizes):
        for s in sorted(made, reverse=True):
            if s + n <= target and s + n not in made:
                made[s + n] = (i, s)
    if target not in made:
        return None
    out, at = [], target
    while made[at] is not None:
        i, at = made[at]
        out.append(i)
    return out[::-1]


def exact_splits(groups: DataFrame, counts: DataFrame, seed: int = SEED) -> DataFrame:
    """(stratum, grp, split): whole groups (stratum, grp, size) that meet exact counts.

    ``counts`` has (stratum, validation, test); groups go in hash order, test first.  A
    stratum is one task; its groups must be few enough for the sums to be listed.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = pdf.sort_values("h"), []
        for split in ("test", "validation"):
            left = left.sort_values(f"h_{split}")
            chosen = subset(left["size"].tolist(), int(left[split].iloc[0]) if len(left) else 0)
            if chosen is None:
                raise ValueError(f"the groups of {key[0]} cannot give exactly the count of {split}")
            out.append(left.iloc[chosen].assign(split=split))
            left = left.drop(left.index[chosen])
        return pd.concat([*out, left.assign(split="train")])[["stratum", "grp", "split"]]

    order = lambda label: F.sha2(F.concat_ws(":", F.lit(str(seed)), "stratum", F.lit(label), "grp").cast("binary"), 256)
    g = groups.join(counts, "stratum").withColumn("h", order("")).withColumn("h_test", order("test")).withColumn("h_validation", order("validation"))
    return g.groupBy("stratum").applyInPandas(run, "stratum string, grp string, split string")


def exact_count_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language and split when every group of 16 hash classes moves whole.

    The wanted counts are those of the groups that a plain hash order gives, so they can be met.
    """
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("stratum"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(16)).cast("string").alias("grp"))
    g = written(d.groupBy("stratum", "grp").agg(F.count("*").alias("size")), "sizes")
    wanted = g.groupBy("stratum").agg(F.sum(F.when(F.col("grp") == "3", F.col("size")).otherwise(0)).alias("test"), F.sum(F.when(F.col("grp") == "5", F.col("size")).otherwise(0)).alias("validation"))
    out = exact_splits(g, wanted).join(g, ["stratum", "grp"])
    return out.groupBy(F.col("stratum").alias("lang"), "split").agg(F.sum("size").alias("documents"))


def leaks(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values that lie in more than one split, with the splits in order."""
    seen = [F.max(F.col(split) == s).alias(f"_{s}") for s in SPLITS]
    g = df.groupBy(value).agg(*seen, F.count("*").alias("rows"))
    names = F.array_compact(F.array(*(F.when(F.col(f"_{s}"), s) for s in SPLITS)))
    return g.select(value, F.array_join(names, ",").alias("splits"), "rows").where(F.contains("splits", F.lit(",")))


def assignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, violations): groups, exact texts and edges of the token-balanced splits."""
    from . import neardup

    d = _weights(spark, sf_dir).select("doc_id", "grp")
    a = written(d.join(bounded(written(token_balanced(spark, sf_dir).select("grp", "split"), "splits")), "grp").select("doc_id", "grp", "split"), "assigned")
    texts = a.join(table(spark, sf_dir, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash")), "doc_id")
    edges = neardup.crossing_edges(table(spark, sf_dir, "documents"), a.select(F.col("doc_id").alias("id"), F.col("split").alias("label")))
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    return one("groups", leaks(a, "grp")).union(one("exact_texts", leaks(texts, "text_hash"))).union(edges.select(F.lit("near_duplicate_edges").alias("check"), F.col("edges").alias("violations")))


def split_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(status, documents): ids missing from, unexpected in, or wrongly assigned by a manifest.

    The manifest is the hash split of the labelled documents, ids shifted for every tenth.
    """
    m = hash_splits(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    m = m.select(F.when(F.col("doc_id") % 10 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("split")).alias("split"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("here"))
    j = d.join(m, "doc_id", "full_outer")
    status = F.when(F.col("here").isNull(), "unexpected").when(F.col("split").isNull(), "missing").when(~F.col("split").isin(*SPLITS), "invalid").otherwise("assigned")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("documents"))


def lexical_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dimension, value, splits, rows): values of four dimensions that cross the hash splits."""
    d = hash_splits(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", X.words(F.col("text")).alias("w")), "doc_id")
    kinds = {"lang": F.col("lang"), "source": F.col("source"), "first_word": F.get("w", 0), "opening": F.array_join(F.slice("w", 1, 4), " ")}
    values = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in kinds.items()))
    v = d.select("split", F.inline(values)).where("value IS NOT NULL").withColumn("key", F.concat_ws("\x00", "dimension", "value"))
    return leaks(v, "key").select(F.substring_index("key", "\x00", 1).alias("dimension"), F.regexp_extract("key", "\x00(?s:(.*))$", 1).alias("value"), "splits", "rows")


def excluded_training_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that training leaves out: toxic documents and those of the benchmark's contaminated, assigned to train."""
    from .audits import contamination

    split = hash_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    named = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("explicit").alias("reason"))
    hits = contamination(8)(spark, sf_dir).select("doc_id").distinct().join(split.where("split = 'train'"), "doc_id", "left_semi").select("doc_id", F.lit("assigned_to_train").alias("reason"))
    return named.union(hits).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


QUERIES = {
    "token_balanced_splits": token_balanced, "anchored_group_splits": anchored, "balanced_new_sources": balanced_new_sources, "exact_count_splits": exact_count_splits,
    "assignment_audit": assignment_audit, "split_reconciliation": split_reconciliation, "lexical_isolation": lexical_isolation, "excluded_training_ids": excluded_training_ids,
}


def _sqls() -> dict[str, str]:
    from .audits import _SPLITS, _contamination_sql

    w = f"SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS grp, {X.SQL_COUNT} AS n FROM documents"
    pick_filled = "CASE WHEN a / t0 <= b / t1 AND a / t0 <= c / t2 THEN 0 WHEN b / t1 <= c / t2 THEN 1 ELSE 2 END"
    gap = lambda k: " + ".join(f"pow(({x} + {'size' if j == k else '0'} - t{j}) / t{j}, 2)" for j, x in enumerate("abc"))
    pick_gap = f"CASE WHEN {gap(0)} <= {gap(1)} AND {gap(0)} <= {gap(2)} THEN 0 WHEN {gap(1)} <= {gap(2)} THEN 1 ELSE 2 END"
    walk = lambda pick: (
        f"walk(i, a, b, c, k) AS (SELECT 0::BIGINT, (SELECT s0 FROM aim)::DOUBLE, (SELECT s1 FROM aim)::DOUBLE, (SELECT s2 FROM aim)::DOUBLE, -1 UNION ALL "
        f"SELECT i + 1, a + CASE WHEN p = 0 THEN size ELSE 0 END, b + CASE WHEN p = 1 THEN size ELSE 0 END, c + CASE WHEN p = 2 THEN size ELSE 0 END, p "
        f"FROM (SELECT walk.*, o.size, {pick} AS p FROM walk JOIN o ON o.rn = walk.i + 1, aim))"
    )
    name = "CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"
    balanced = (
        f"WITH RECURSIVE w AS ({w}), g AS (SELECT grp, sum(n)::BIGINT AS size FROM w GROUP BY grp), o AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || grp)) AS rn FROM g), "
        f"aim AS (SELECT greatest(1.0::DOUBLE, sum(size) * 0.85::DOUBLE) AS t0, greatest(1.0::DOUBLE, sum(size) * 0.075::DOUBLE) AS t1, greatest(1.0::DOUBLE, sum(size) * 0.075::DOUBLE) AS t2, 0 AS s0, 0 AS s1, 0 AS s2 FROM g), {walk(pick_filled)}, "
        f"tb AS (SELECT grp, size, {name} AS split FROM walk JOIN o ON o.rn = walk.i)"
    )
    d = "d AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS grp FROM documents)"
    aims = "round_even({n} * 0.85::DOUBLE, 0) AS q0, round_even({n} * 0.075::DOUBLE, 0) AS q1, {n} AS q"
    leak = "array_to_string(list_filter(['train', 'validation', 'test'], lambda x: list_contains(list(DISTINCT split), x)), ',')"
    return {
        "token_balanced_splits": f"{balanced} SELECT * FROM tb",
        "anchored_group_splits": f"""WITH RECURSIVE {_SPLITS}, {d}, v AS (SELECT grp, count(*) AS size, count(*) FILTER (s.split = 'train') AS x, count(*) FILTER (s.split = 'validation') AS y, count(*) FILTER (s.split = 'test') AS z
            FROM d LEFT JOIN (SELECT doc_id, split FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 40 < 20)) s USING (doc_id) GROUP BY grp),
          f AS (SELECT grp, size, CASE WHEN x >= y AND x >= z THEN 'train' WHEN y >= z THEN 'validation' ELSE 'test' END AS split, (x > 0)::INT + (y > 0)::INT + (z > 0)::INT > 1 AS conflict FROM v WHERE x + y + z > 0),
          o AS (SELECT grp, size, row_number() OVER (ORDER BY size DESC, sha256('{SEED}:' || grp)) AS rn FROM v WHERE x + y + z = 0),
          a0 AS (SELECT {aims.format(n='(SELECT sum(size) FROM v)')}), aim AS (SELECT q0::DOUBLE AS t0, q1::DOUBLE AS t1, (q - q0 - q1)::DOUBLE AS t2, {", ".join(f"coalesce((SELECT sum(size) FROM f WHERE split = '{s}'), 0) AS s{k}" for k, s in enumerate(SPLITS))} FROM a0), {walk(pick_gap)}
          SELECT grp, size AS documents, split, TRUE AS anchored, conflict FROM f UNION ALL SELECT grp, size, {name}, FALSE, FALSE FROM walk JOIN o ON o.rn = walk.i""",
        "balanced_new_sources": f"""WITH RECURSIVE {_SPLITS}, {d}, h AS (SELECT split, count(*) AS n FROM s WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY split), a0 AS (SELECT {aims.format(n='(SELECT count(*) FROM documents)')}),
          g AS (SELECT grp, count(*) AS size FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY grp), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, sha256('{SEED}:' || grp)) AS rn FROM g),
          aim AS (SELECT greatest(1, q0 - coalesce((SELECT n FROM h WHERE split = 'train'), 0))::DOUBLE AS t0, greatest(1, q1 - coalesce((SELECT n FROM h WHERE split = 'validation'), 0))::DOUBLE AS t1,
            greatest(1, q - q0 - q1 - coalesce((SELECT n FROM h WHERE split = 'test'), 0))::DOUBLE AS t2, 0 AS s0, 0 AS s1, 0 AS s2 FROM a0), {walk(pick_gap)} SELECT grp, size AS documents, {name} AS split FROM walk JOIN o ON o.rn = walk.i""",
        "split_reconciliation": f"""WITH l AS (SELECT DISTINCT doc_id FROM labels), {_SPLITS.replace("FROM documents", "FROM l")}, m AS (SELECT CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE split END AS split FROM s)
          SELECT CASE WHEN documents.doc_id IS NULL THEN 'unexpected' WHEN split IS NULL THEN 'missing' WHEN split = 'other' THEN 'invalid' ELSE 'assigned' END AS status, count(*) AS documents FROM documents FULL OUTER JOIN m ON doc_id = id GROUP BY 1""",
        "lexical_isolation": f"""WITH {_SPLITS}, w AS (SELECT split, lang, source, {X.SQL_WORDS} AS w FROM s), v AS (SELECT split, 'lang' AS dimension, lang AS value FROM w UNION ALL SELECT split, 'source', source FROM w UNION ALL SELECT split, 'first_word', w[1] FROM w
          UNION ALL SELECT split, 'opening', array_to_string(w[1:4], ' ') FROM w) SELECT dimension, value, {leak} AS splits, count(*) AS rows FROM v WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
        "excluded_training_ids": f"WITH {_SPLITS}, c AS ({_contamination_sql(8)}), x AS (SELECT doc_id, 'explicit' AS r FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'assigned_to_train' FROM c WHERE doc_id IN (SELECT doc_id FROM s WHERE split = 'train')) "
        "SELECT doc_id, string_agg(r, ',' ORDER BY r) AS reasons FROM x GROUP BY doc_id",
    }


ORACLE_SQL = _sqls()
