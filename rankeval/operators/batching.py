"""Batches by token budget, as an encoder wants them: rows of like length together, none over the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankeval.functions import order
from rankeval.sources.store import staged

#: Rows of one length are numbered in so many pieces, so that a common length is not one task.
SLOTS = 64


def batched(rows: DataFrame, *, key: str, tokens: str, budget: int, most: int) -> DataFrame:
    """rows with `batch`, from 0: by length, a batch takes rows while they fit the budget and are at most `most`.

    A row beyond the budget is alone; no length counts as 0. Rows of one length are interchangeable, so where batches end
    follows from the number of rows of each length: one row a length comes together, never the rows themselves.
    """
    t = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    placed = staged(rows.withColumns({"_t": t, "_slot": F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")}), "lengths")
    sizes = placed.groupBy("_t", "_slot").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("_t", "_slot", (F.sum("n").over(Window.partitionBy("_t").orderBy("_slot")) - F.col("n")).alias("_before"))
    starts = F.broadcast(staged(_starts(sizes.groupBy("_t").agg(F.sum("n").alias("n")), budget, most), "starts"))  # a row a length
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_t", "_slot").orderBy(key)) - 1
    numbered = placed.join(offsets, ["_t", "_slot"]).withColumn("_i", number).join(starts, "_t")
    later = F.col("_open") + 1 + F.floor((F.col("_i") - F.col("_free")) / F.col("_fit"))
    return numbered.select(*rows.columns, F.when(F.col("_i") < F.col("_free"), F.col("_open")).otherwise(later).cast("long").alias("batch"))


def _starts(lengths: DataFrame, budget: int, most: int) -> DataFrame:
    """(_t, _open, _free, _fit): the batch that is open when a length begins, how many rows of it that still takes, how many a new one takes."""
    one = lengths.agg(F.sort_array(F.collect_list(F.struct("_t", "n"))).alias("l"))
    whole = lambda x: F.lit(x).cast("long")
    kind = "struct<open: bigint, rows: bigint, tokens: bigint, out: array<struct<_t: bigint, _open: bigint, _free: bigint, _fit: bigint>>>"
    start = F.struct(whole(0).alias("open"), whole(0).alias("rows"), whole(0).alias("tokens"), F.array().cast("array<struct<_t: bigint, _open: bigint, _free: bigint, _fit: bigint>>").alias("out")).cast(kind)

    def fits(t: Column, rows: Column, held: Column) -> Column:
        room = F.when(t == 0, whole(most)).otherwise(F.floor((budget - held) / F.greatest(t, whole(1))))
        return F.greatest(whole(0), F.least(whole(most) - rows, room)).cast("long")

    def step(acc: Column, x: Column) -> Column:
        t, n = x["_t"], x["n"]
        fit = F.greatest(whole(1), fits(t, whole(0), whole(0)))
        free = F.when(acc["rows"] == 0, fit).otherwise(fits(t, acc["rows"], acc["tokens"]))
        rest = n - F.least(n, free)
        new = F.ceil(rest / fit).cast("long")
        last = rest - (new - 1) * fit
        rows = F.when(rest == 0, acc["rows"] + n).otherwise(last)
        held = F.when(rest == 0, acc["tokens"] + n * t).otherwise(last * t)
        entry = F.struct(t.alias("_t"), acc["open"].alias("_open"), free.alias("_free"), fit.alias("_fit"))
        return F.struct((acc["open"] + new).alias("open"), rows.alias("rows"), held.alias("tokens"), F.array_append(acc["out"], entry).alias("out")).cast(kind)

    return one.select(F.inline(F.aggregate("l", start, step, lambda acc: acc["out"])))


def rates(batches: DataFrame, tokens: str) -> DataFrame:
    """One row: batches, the mean rows and tokens of one, the median and largest tokens."""
    each = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("held"))
    whole = each.agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("rows"), 4).alias("rows_each"), F.round(F.avg("held"), 4).alias("tokens_each"), F.max("held").alias("fullest"))
    return order.beside(whole, order.upper_median(each, "held", []), [])
