"""Repeatable resampling: indices from integer arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES, SEED = 10_000, 260_209
_MASK = (1 << 31) - 1
# Multipliers of the mixing steps.
_A, _B, _REPLICATE, _INDEX = 0x2C1B3C6D, 0x297A2D39, 7919, 104_729


def scramble(h: Column) -> Column:
    """31 mixed bits of a non-negative long."""
    cut = lambda c: c.bitwiseAND(F.lit(_MASK))
    mix = lambda c, s: c.bitwiseXOR(F.shiftright(c, s))
    h = cut(mix(cut(h), 15) * F.lit(_A))
    h = cut(mix(h, 12) * F.lit(_B))
    return mix(h, 15)


def draw(replicate: Column, i: Column, n: Column, seed: int = SEED) -> Column:
    """The i-th resampled index, 0 to n-1, of a replicate."""
    return F.shiftright(scramble(scramble(replicate * F.lit(_REPLICATE) + F.lit(seed)) + i * F.lit(_INDEX)) * n, 31)


def bootstrap_rates(counts: DataFrame, keys: list[str], replicates: int = REPLICATES) -> DataFrame:
    """keys + low, high, replicates: 95 % percentile interval of a rate, n rows of which s succeed.

    ``counts`` has (keys, n, s).  Rows of one outcome are alike, so an index below s is a
    success and no row is needed; each replicate draws its n indices.
    """
    r = counts.select(*keys, "n", "s", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("r"))
    # Replicates spread over the tasks; their draws are rows, so the arithmetic is compiled.
    r = r.repartition(*keys, "r").select(*keys, "n", "s", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    r = r.groupBy(*keys, "r", "n").agg(F.count_if(draw(F.col("r"), F.col("i"), F.col("n")) < F.col("s")).alias("wins"))
    r = r.select(*keys, (F.col("wins") / F.col("n")).alias("rate"))
    return r.groupBy(*keys).agg(F.round(F.percentile("rate", 0.025), 9).alias("low"), F.round(F.percentile("rate", 0.975), 9).alias("high"), F.count("rate").alias("replicates"))


_CHAIN = (
    f"SELECT *, xor(z3, z3 >> 15) AS y FROM (SELECT *, (xor(z2, z2 >> 12) * {_B}) & {_MASK} AS z3 FROM (SELECT *, (xor(x & {_MASK}, (x & {_MASK}) >> 15) * {_A}) & {_MASK} AS z2 FROM ({{t}})))"
)
_CLEAN = "SELECT * EXCLUDE (z2, z3, x, y), y AS {name} FROM ({t})"


def sql_draws(t: str, replicates: int = REPLICATES) -> str:
    """For DuckDB: rows of ``t`` (with n) times replicates r times indices i, the drawn index as ``drawn``."""
    first = f"SELECT *, r * {_REPLICATE} + {SEED} AS x FROM (SELECT *, unnest(range(1, {replicates + 1})) AS r FROM ({t}))"
    first = _CLEAN.format(name="rs", t=_CHAIN.format(t=first))
    second = f"SELECT *, rs + i * {_INDEX} AS x FROM (SELECT *, unnest(range(n)) AS i FROM ({first}))"
    return f"SELECT *, (hs * n) >> 31 AS drawn FROM ({_CLEAN.format(name='hs', t=_CHAIN.format(t=second))})"


def sql_intervals(t: str, keys: str, replicates: int = REPLICATES) -> str:
    return (
        f"SELECT {keys}, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high, count(rate) AS replicates FROM "
        f"(SELECT {keys}, r, count(*) FILTER (drawn < s) / any_value(n) AS rate FROM ({sql_draws(t, replicates)}) GROUP BY ALL) GROUP BY ALL"
    )
