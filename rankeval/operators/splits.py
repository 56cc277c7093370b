"""Reproducible splits: half of each group to either side, a quota by largest remainders, selection in the split's order."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankeval.session import ship


class SplitError(ValueError):
    """Sides overlap, or the small slice is not within its side."""


def largest_remainder(groups: DataFrame, target: int, *, group: str = "group", count: str = "n") -> DataFrame:
    """(group, n, quota): target dealt in proportion to n. Floors first, then one each by remainder, never beyond n.

    groups has one row for each group: a small table, so one window over it is fine.
    """
    pool = groups.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("pool"))
    g = groups.select(F.col(group), F.col(count).cast("long").alias("n")).join(F.broadcast(pool))
    exact = F.col("n") * F.lit(target).cast("long")
    g = g.select(group, "n", F.when(F.col("pool") > 0, F.least("n", F.expr(f"({target}L * n) div pool"))).otherwise(0).cast("long").alias("whole"), F.when(F.col("pool") > 0, exact % F.col("pool")).otherwise(0).alias("rest"))
    room = F.when(F.col("whole") < F.col("n"), 0).otherwise(1)
    order = F.row_number().over(Window.orderBy(room, F.desc("rest"), group))
    left = F.lit(target) - F.sum("whole").over(Window.partitionBy())
    extra = F.when((room == 0) & (order <= left) & (F.sum("n").over(Window.partitionBy()) > 0), 1).otherwise(0)
    return g.select(group, "n", (F.col("whole") + extra).cast("long").alias("quota"))


def stratified(rows: DataFrame, seed: int, *, key: str = "instance_id", group: str = "group") -> DataFrame:
    """(key, group, side, pos): the half of each group (rounded half to even) with the smallest seeded hashes is `dev`."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))
    sizes = rows.groupBy(group).agg(F.bround(F.count(F.lit(1)) * F.lit(0.5)).cast("long").alias("cut"))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return rows.select(key, group, pos.alias("pos")).join(sizes, group).select(key, group, F.when(F.col("pos") <= F.col("cut"), "dev").otherwise("test").alias("side"), F.col("pos").cast("long").alias("pos"))


def shuffled(rows: DataFrame, seed: int, *, key: str = "instance_id", group: str = "group") -> DataFrame:
    """As stratified(), with the order of Python's generator seeded by `seed:group`; ids are sorted first.

    A group's ids meet in one task, as the generator shuffles a whole list.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf[key])
        random.Random(f"{seed}:{pdf[group].iloc[0]}").shuffle(ids)
        cut = round(len(ids) * 0.5)
        return pd.DataFrame({key: ids, group: pdf[group].iloc[0], "side": ["dev" if i < cut else "test" for i in range(len(ids))], "pos": range(1, len(ids) + 1)})

    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(key, group).groupBy(group).applyInPandas(deal, f"{key} {kinds[key]}, {group} {kinds[group]}, side string, pos long")


def seeded_sample(rows: DataFrame, n: int, *, seed: int = 0, key: str = "instance_id") -> DataFrame:
    """(key, ord): n of the sorted ids by Python's generator, in its order; all of them, shuffled, if there are no more.

    The generator draws places in the sorted list, so only its n draws and one count reach the driver; a place is found by
    counting the ids in front of it, partition by partition.
    """
    ids = rows.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    sizes = {r.part: r.n for r in ids.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    drawn = random.Random(seed).sample(range(total), min(n, total))
    before, starts = 0, {}
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    spark = rows.sparkSession
    first = spark.createDataFrame(sorted(starts.items()), "part int, first long")
    picks = spark.createDataFrame(list(zip(drawn, range(len(drawn)), strict=True)), "at long, ord long")
    at = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return ids.withColumn("within", at).join(F.broadcast(first), "part").withColumn("at", F.col("first") + F.col("within")).join(F.broadcast(picks), "at").select(key, "ord").orderBy("ord")


def ci_slice(split: DataFrame, quotas: DataFrame, *, key: str = "instance_id", group: str = "group") -> DataFrame:
    """The first rows of each group's dev side, as many as its quota."""
    return split.where("side = 'dev'").join(quotas.select(group, "quota"), group).where(F.col("pos") <= F.col("quota")).select(key, group)


def select_side(rows: DataFrame, split: DataFrame, side: str, *, key: str = "instance_id") -> DataFrame:
    """Rows of a side in the split's order (`ord`); ids that rows do not have are passed over."""
    return rows.join(split.where(F.col("side") == side).select(key, "ord"), key).orderBy("ord")


def guard_counts(split: DataFrame, *, key: str = "instance_id") -> DataFrame:
    """One row: ids on both sides, and ids of the slice that are not in dev. split: (key, side), side in dev, test, ci."""
    side = lambda s: split.where(F.col("side") == s).select(key)
    both = side("dev").intersect(side("test")).agg(F.count(F.lit(1)).alias("overlap"))
    stray = side("ci").subtract(side("dev")).agg(F.count(F.lit(1)).alias("stray"))
    return both.join(F.broadcast(stray))


def check(split: DataFrame, *, key: str = "instance_id") -> None:
    row = guard_counts(split, key=key).first()
    if row.overlap or row.stray:
        raise SplitError(f"{row.overlap} rows on both sides, {row.stray} of the slice outside dev")
