"""Run budgets and progress over rows in a fixed order (`seq`), as running sums.

Running sums over one order are made in two levels: sums of ranges of seq first, then within each range, so no task holds
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096
EVERY = 10


def running(df: DataFrame, sums: dict[str, Column], *, seq: str = "seq", inclusive: bool = True, width: int = RANGE) -> DataFrame:
    """df with running totals by seq (of all rows up to this one, or before it)."""
    rows = df.withColumn("_range", F.floor(F.col(seq) / width))
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums))
    own = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.join(totals, "_range")
    return rows.select(*df.columns, *((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_t_{n}")).alias(n) for n, c in sums.items()))


def progress(df: DataFrame, *, every: int = EVERY) -> DataFrame:
    """(seq, hits, spent, elapsed) every so many rows and at the end. df: (seq, hit, cost, latency), seq from 1."""
    n = df.agg(F.max("seq").alias("last"))
    r = running(df, {"hits": F.col("hit").cast("long"), "spent": F.col("cost"), "elapsed": F.col("latency")})
    return r.join(F.broadcast(n)).where((F.col("seq") % every == 0) | (F.col("seq") == F.col("last"))).drop("last")


def projected_gate(df: DataFrame, cap: float) -> DataFrame:
    """df (seq, cost, cached) with spent, calls and `refused`: what is spent so far and another mean call would pass the cap."""
    live = ~F.col("cached")
    r = running(df, {"spent": F.when(live, F.col("cost")).otherwise(0.0), "calls": F.when(live, 1).otherwise(0)}, inclusive=False)
    return r.withColumn("refused", (F.col("calls") > 0) & (F.round(F.col("spent") + F.col("spent") / F.col("calls"), 6) > cap))


def spent_gate(df: DataFrame, cap: float) -> DataFrame:
    """df (seq, cost) with spent and `refused`: what is spent so far reaches the cap."""
    r = running(df, {"spent": F.col("cost")}, inclusive=False)
    return r.withColumn("refused", F.round("spent", 6) >= cap)


def instance_budget(calls: DataFrame, cap: int) -> DataFrame:
    """calls (instance, seq, ...) with `run`: the first cap calls of an instance are made, the others refused."""
    w = Window.partitionBy("instance").orderBy("seq")
    return calls.withColumn("run", F.row_number().over(w) <= cap)
