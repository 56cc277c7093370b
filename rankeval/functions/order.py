"""Exact order statistics of groups of any size: rows are counted into ranges, and only the wanted places are picked.

Equal values of a group become one row with its count, these are partitioned by range of (group, value), and the ranges'
totals tell in which of them, and at which value, a place lies. No group is ever in one row or one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankeval.sources.store import staged


def selected(df: DataFrame, value: str, groups: list[str], places: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(groups, n, names of places): the values at 1-based places of each group in ascending order, nulls left out.

    places gives the place of each name from the group's size n. Groups without a value are missing.
    """
    key = F.struct(F.lit(0).alias("_"), *groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranges = staged(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranges")
    by_group = Window.partitionBy("g")
    totals = ranges.groupBy("part", "g").agg(F.sum("c").alias("held"))  # a row for each partition and the groups in it
    totals = totals.select("part", "g", F.sum("held").over(by_group).alias("n"), (F.sum("held").over(by_group.orderBy("part")) - F.col("held")).alias("before"))
    names = list(places(F.lit(1)))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), p.cast("long").alias("p")) for i, p in enumerate(places(F.col("n")).values())))
    end = F.col("before") + F.sum("c").over(Window.partitionBy("part", "g").orderBy("v"))
    rows = ranges.join(totals, ["part", "g"]).select("g", "n", "v", "c", end.alias("end"))
    here = F.filter(wanted, lambda w: (w["p"] > F.col("end") - F.col("c")) & (w["p"] <= F.col("end")))
    found = rows.select("g", "n", "v", F.explode(here).alias("w"))
    out = found.groupBy("g").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("w.i") == i, F.col("v"))).alias(name) for i, name in enumerate(names)))
    return out.select(*(F.col(f"g.`{c}`") for c in groups), "n", *names)


def upper_median(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(groups, median): the upper of the two middle values."""
    return selected(df, value, groups, lambda n: {"median": F.floor(n / 2) + 1}).drop("n")


def quantiles_exclusive(df: DataFrame, value: str, groups: list[str], wanted: dict[str, float]) -> DataFrame:
    """(groups, names): quantiles at place p (n + 1), in proportion between neighbours, as the exclusive method has it."""

    def low(p: float, n: Column) -> Column:
        return F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(p) * (n + 1))))

    def places(n: Column) -> dict[str, Column]:
        return {f"{k}_low": low(p, n) for k, p in wanted.items()} | {f"{k}_high": F.least(low(p, n) + 1, n) for k, p in wanted.items()}

    rows, n = selected(df.withColumn(value, F.col(value).cast("double")), value, groups, places), F.col("n")
    share = {k: F.lit(p) * (n + 1) - low(p, n) for k, p in wanted.items()}
    return rows.select(*groups, *(F.when(n == 1, F.col(f"{k}_low")).otherwise(F.col(f"{k}_low") * (1 - s) + F.col(f"{k}_high") * s).alias(k) for k, s in share.items()))


def beside(rows: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """rows with the columns of more for the same groups, nulls being a group; null where more has none."""
    if not groups:
        return rows.withColumn("_", F.lit(0)).join(more.withColumn("_", F.lit(0)), "_", "left").drop("_")
    names = {c: f"_{c}" for c in groups}
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(m)) for c, m in names.items()))
    return rows.join(more.withColumnsRenamed(names), same, "left").drop(*names.values())
