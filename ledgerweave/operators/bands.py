"""Joins of amounts that agree within a tolerance, as equi-joins over bands.

A band is as wide as the tolerance where it lies: ``floor`` near zero, a share ``pct`` of the amount far from it.  Two
amounts that agree are in the same band or in neighbouring ones, so one side is looked up in three bands; the exact
condition stays with the caller, on rows whose amounts are no more than two bands apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(amount: Column, pct: float = 0.0, floor: float = 1.0) -> Column:
    """The band of an amount: |a - b| <= floor + pct * |b| puts a and b at most one band apart; null for null.

    It is the whole part of the integral of 1 / (floor + pct * x), shrunk by (1 - pct) for the tolerance is taken at
    either end, and by a thousandth for rounding.
    """
    x = amount.cast("double")
    steps = F.abs(x) / F.lit(float(floor)) if not pct else F.log1p(F.abs(x) * (pct / float(floor))) / pct
    return F.floor(F.signum(x) * steps * ((1 - pct) * 0.999)).cast("bigint")


def band_join(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], amounts: tuple[str, str], pct: float = 0.0, floor: float = 1.0) -> DataFrame:
    """Rows of both sides (no column in common) with equal columns and amounts up to two bands apart."""
    at = band(F.col(amounts[0]), pct, floor)
    probes = left.withColumn("_band", F.explode(F.array(at - 1, at, at + 1)))
    index = right.withColumn("_at", band(F.col(amounts[1]), pct, floor))
    on = reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in [*equal, ("_band", "_at")]))
    return probes.join(index, on).drop("_band", "_at")


#: Bands that stand in one slot, as a power of two.
SLOT = 2


def met_once(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], amounts: tuple[str, str], agree: Column, pct: float = 0.0, floor: float = 1.0, how: str = "inner", parts: int = 0) -> DataFrame:
    """Rows of both sides with equal columns and amounts that agree, without a copy of left rows: a right row stands in each slot
    (of four bands) that one of its neighbours can lie in, so a left row finds all that agree in one slot, named ``_slot``, and in one
    task.  What is counted for each left row there needs no further exchange.  parts: tasks to deal both sides over."""
    deal = lambda rows, *keys: rows.repartition(parts, *keys) if parts else rows
    at = band(F.col(amounts[1]), pct, floor)
    probes = left.withColumn("_slot", F.shiftright(band(F.col(amounts[0]), pct, floor), SLOT))
    index = right.withColumn("_in", F.explode(F.array_distinct(F.array(F.shiftright(at - 1, SLOT), F.shiftright(at + 1, SLOT)))))
    on = reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in [*equal, ("_slot", "_in")]))
    return deal(probes, *(x for x, _ in equal), "_slot").join(deal(index, *(y for _, y in equal), "_in"), on & agree, how).drop("_in")


def two_sum(targets: DataFrame, parts: DataFrame, keys: list[str], target: str, part: str, part_id: str, pct: float, floor: float) -> DataFrame:
    """Targets with two parts (``a`` before ``b`` by id) whose sum is up to two bands from the target; both have the keys.

    Each part is taken from the target, and what is left is looked up among the other parts by its band, which lies
    around zero: so a group of n parts costs n look-ups a target, not n * n pairs.  Adds a, b, amount_a and amount_b.
    """
    one = parts.select(*keys, F.col(part_id).alias("a"), F.col(part).alias("amount_a"))
    other = parts.select(*(F.col(k).alias(f"{k}_b") for k in keys), F.col(part_id).alias("b"), F.col(part).alias("amount_b"))
    left = targets.join(one, keys).withColumn("_left", F.col(target) - F.col("amount_a"))
    # the tolerance follows the target: bands of the target's own width, written beside it
    width = F.lit(float(floor)) + F.abs(F.col(target)) * pct
    level = F.ceil(F.log2(width)).cast("int")
    cell = lambda x, lev: F.floor(x / F.pow(F.lit(2.0), lev)).cast("bigint")
    probes = left.withColumn("_level", level).withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: cell(F.col("_left"), F.col("_level")) + k)))
    levels = targets.select(*(F.col(k).alias(f"{k}_b") for k in keys), level.alias("_other")).distinct()
    index = other.join(levels, [f"{k}_b" for k in keys]).withColumn("_at", cell(F.col("amount_b"), F.col("_other")))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_b") for k in keys)) & (F.col("_level") == F.col("_other")) & (F.col("_cell") == F.col("_at"))
    return probes.join(index, on & (F.col("a") < F.col("b"))).drop("_left", "_level", "_cell", "_other", "_at", *(f"{k}_b" for k in keys))
