"""Exact quantiles in bounded memory: histograms narrow down where the wanted ranks lie.

Groups of few rows go through ``percentile``. In a large group each pass counts the values
that lie in the current range of a rank by equal bins, and the bin that holds the rank is
the next range; its rows are ranked when they are few, or have one value. No task holds a
group's values, and the result is the interpolation that ``percentile`` gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free, stored

FEW = 20_000  # rows of a group, or of a range, that a task may hold
BINS = 2048
BROADCAST_ROWS = 100_000  # ranges that go to all tasks; more meet by a shuffle


def _at(n: Column, p: float) -> tuple[Column, Column]:
    """(lower rank, its fraction above) of the quantile ``p`` of ``n`` values, from 0."""
    place = (n - 1) * F.lit(float(p))
    return F.floor(place), place - F.floor(place)


def _narrowed(rows: DataFrame, want: DataFrame, by: list[str]) -> DataFrame:
    """``want`` (by..., rank, low, high, below, n) after one histogram of each of its ranges."""
    ranges = want.select(*by, "low", "high", "below").distinct()
    ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    inside = rows.join(ranges, by).where(F.col("v_").between(F.col("low"), F.col("high")))
    part = F.floor((F.col("v_") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)
    held = inside.groupBy(*by, "low", "high", "below", F.least(part, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v_").alias("first"), F.max("v_").alias("last"))
    running = Window.partitionBy(*by, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # ``BINS`` rows a range at most
    held = held.withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(running), F.lit(0)))
    met = want.drop("n", "below").join(held.drop("below"), [*by, "low", "high"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
    return stored(met.select(*by, "rank", F.col("first").alias("low"), F.col("last").alias("high"), F.col("before").alias("below"), F.col("c").alias("n")), "ranges")


def _ranked(rows: DataFrame, want: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rank, v) of the ranks of ``want`` whose ranges have one value or few rows."""
    one = want.where("low = high").select(*by, "rank", F.col("low").alias("v"))
    few = want.where("low < high")
    ranges = few.select(*by, "low", "high", "below").distinct()
    ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    inside = rows.join(ranges, by).where(F.col("v_").between(F.col("low"), F.col("high")))
    nth = F.row_number().over(Window.partitionBy(*by, "low", "high").orderBy("v_")) - 1 + F.col("below")
    return one.unionByName(inside.withColumn("rank", nth).join(few.select(*by, "rank", "low", "high"), [*by, "low", "high", "rank"]).select(*by, "rank", F.col("v_").alias("v")))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], name: str = "q", few: int = FEW) -> DataFrame:
    """(by..., name): the interpolated quantiles ``ps`` of ``value`` in each group, as an array; nulls do not count.

    A group without values has no row, and no ``by`` is one group. Values are doubles
    that are finite; groups of null keys are groups.
    """
    keys = [f"k{i}_" for i in range(len(by))] or ["k0_"]
    own = [F.struct(F.col(c).alias("k")).alias(k) for c, k in zip(by, keys, strict=bool(by))] if by else [F.lit(0).alias("k0_")]  # a struct joins with its like, null or not
    table = rows.where(F.col(value).isNotNull()).select(*own, F.col(value).cast("double").alias("v_"))
    about = stored(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high")), "groups")
    large = about.where(F.col("n") > few)
    back = [F.col(f"{k}.k").alias(c) for c, k in zip(by, keys, strict=True)] if by else []
    array = F.array(*(F.lit(float(p)) for p in ps))
    if large.isEmpty():
        return table.groupBy(*keys).agg(F.percentile("v_", array).alias(name)).select(*back, name)
    small = table.join(large.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.percentile("v_", array).alias(name))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(_at(F.col("n"), p)[0], F.least(_at(F.col("n"), p)[0] + 1, F.col("n") - 1)) for p in ps))))
    want = stored(large.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "n"), "ranges")
    done = None
    while True:
        ready = (F.col("low") == F.col("high")) | (F.col("n") <= few)
        found = stored(_ranked(table, want.where(ready), keys), "ranked")
        done = found if done is None else done.unionByName(found)
        rest = want.where(~ready)
        if rest.isEmpty():
            break
        new = _narrowed(table, rest, keys)
        free(want)
        want = new
    values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at_"))  # two a quantile
    met = values.join(large.select(*keys, "n"), keys)

    def one(p: float) -> Column:
        low, share = _at(F.col("n"), p)
        v = F.element_at("at_", low)
        return F.when(share == 0, v).otherwise((1 - share) * v + share * F.element_at("at_", F.least(low + 1, F.col("n") - 1)))

    picked = met.select(*keys, F.array(*(one(p) for p in ps)).alias(name))
    return small.unionByName(picked).select(*back, name)
