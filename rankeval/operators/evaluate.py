"""Scores of runs: per row, overall and by group with small groups together, and paired comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.functions import order
from rankeval.functions.stats import log_mcnemar, mcnemar, ratio, wilson
from rankeval.operators import ranking

SMALL_GROUP = 3
OTHER = "other"


class UnknownRows(ValueError):
    """A run names rows that the truth does not have, or two runs do not cover the same rows."""


def joined(predictions: DataFrame, truth: DataFrame, key: str = "instance_id") -> DataFrame:
    """Inner join that refuses predictions without truth; the message names five at most."""
    lost = [r[0] for r in predictions.join(truth, key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()]
    if lost:
        raise UnknownRows(f"no truth for {lost}")
    return predictions.join(truth, key)


def score_one(prediction: Column, instance: Column) -> Column:
    """The score of one prediction (a struct of instance_id, ranked_files, latency, cost, stop) for its instance (instance_id, grp, truth).

    The row fails if the ids differ or one is null: a score of the wrong pair would look like any other.
    """
    a, b = prediction["instance_id"], instance["instance_id"]
    ranked, truth = prediction["ranked_files"], instance["truth"]
    score = F.struct(
        a.alias("instance_id"), instance["grp"].alias("grp"), ranking.top1(ranked, truth).alias("hit"), ranking.recall_at(ranked, truth, 3).alias("recall_3"), ranking.recall_at(ranked, truth, 5).alias("recall_5"),
        prediction["latency"].alias("latency"), prediction["cost"].alias("cost"), prediction["stop"].alias("stop"),
    )
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("nothing"))
    return F.when(a == b, score).otherwise(F.raise_error(F.concat(F.lit("prediction of "), shown(a), F.lit(", instance "), shown(b))))


def scores(predictions: DataFrame, instances: DataFrame) -> DataFrame:
    """A row of score_one() for each prediction; predictions of unknown instances are refused."""
    p = predictions.select("instance_id", F.struct("instance_id", "ranked_files", "latency", "cost", "stop").alias("_p"))
    i = instances.select("instance_id", F.struct("instance_id", "grp", "truth").alias("_i"))
    return joined(p, i).select(score_one(F.col("_p"), F.col("_i")).alias("s")).select("s.*")


def measures(z: str = "hit") -> list[Column]:
    """Aggregates over (hit, recall_3, recall_5, latency, cost): all rates are 0 for no rows."""
    n, hits = F.count(F.lit(1)), F.coalesce(F.sum(F.col(z).cast("long")), F.lit(0))
    ci = wilson(hits, n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        n.alias("n"), F.round(ratio(hits, n), 6).alias("top_1"), F.round(ci["low"], 6).alias("ci_low"), F.round(ci["high"], 6).alias("ci_high"),
        F.round(zero(F.avg("recall_3")), 6).alias("recall_3"), F.round(zero(F.avg("recall_5")), 6).alias("recall_5"),
        F.round(zero(F.sum("latency")), 6).alias("latency_total"),
        F.round(zero(F.sum("cost")), 6).alias("cost_total"), F.round(ratio(zero(F.sum("cost")), n), 6).alias("cost_each"),
    ]


#: Names of the measures in their order.
MEASURES = ("n", "top_1", "ci_low", "ci_high", "recall_3", "recall_5", "latency_total", "latency_median", "cost_total", "cost_each")


def _measured(rows: DataFrame, scores: DataFrame, groups: list[str]) -> DataFrame:
    """rows of measures() with the median latency of the same groups of scores."""
    both = order.beside(rows, order.upper_median(scores, "latency", groups), groups)
    return both.withColumn("latency_median", F.round(F.coalesce("median", F.lit(0.0)), 6))


def overall(scores: DataFrame) -> DataFrame:
    return _measured(scores.agg(*measures()), scores, []).select(*MEASURES)


def bucketed(scores: DataFrame, group: str, small: int = SMALL_GROUP) -> DataFrame:
    """group with the groups of fewer than small rows named `other`. Group sizes are summed first, so no window holds rows."""
    sizes = scores.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return scores.join(sizes, group).withColumn(group, F.when(F.col("_n") < small, OTHER).otherwise(F.col(group))).drop("_n")


def by_group(scores: DataFrame, group: str, small: int = SMALL_GROUP) -> DataFrame:
    rows = bucketed(scores, group, small)
    return _measured(rows.groupBy(group).agg(*measures()), rows, [group]).select(group, *MEASURES)


def report(scores: DataFrame, group: str, small: int = SMALL_GROUP) -> DataFrame:
    """The overall row (group null) and the group rows in one pass; the medians in another."""
    rows = bucketed(scores, group, small)
    sets = rows.groupingSets([[], [F.col(group)]], group).agg(F.grouping(group).cast("int").alias("_all"), *measures())
    each = F.explode(F.array(F.struct(F.lit(1).alias("_all"), F.lit(None).cast(rows.schema[group].dataType).alias("_g")), F.struct(F.lit(0).alias("_all"), F.col(group).alias("_g"))))
    twice = rows.select("latency", each.alias("s")).select("latency", "s._all", F.col("s._g").alias(group))
    return _measured(sets, twice, ["_all", group]).select(group, *MEASURES)


def matched(a: DataFrame, b: DataFrame, key: str = "instance_id") -> DataFrame:
    """a and b (key, hit) side by side; refuses empty runs and runs over different rows."""
    both = a.select(key, F.col("hit").alias("a_hit")).join(b.select(key, F.col("hit").alias("b_hit")), key, "full_outer")
    off = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a_hit").isNull()).alias("no_a"), F.count_if(F.col("b_hit").isNull()).alias("no_b")).first()
    if not off.n:
        raise UnknownRows("nothing to compare")
    if off.no_a or off.no_b:
        raise UnknownRows(f"{off.no_a} rows are not in the first run, {off.no_b} not in the second")
    return both


def contingency(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_hit"), F.col("b_hit")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("both_hit"), F.count_if(~a & ~b).alias("both_miss"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))


def compared(pairs: DataFrame) -> DataFrame:
    c = contingency(pairs)
    return c.withColumns({"delta": F.round(ratio(F.col("b_only") - F.col("a_only"), "n"), 6), "p_value": F.round(mcnemar("a_only", "b_only"), 8), "log_p": F.round(log_mcnemar("a_only", "b_only"), 6)})


def verdict() -> Column:
    """Of compared() rows."""
    return F.when(F.col("a_only") + F.col("b_only") == 0, "nothing to test").when(F.col("p_value") >= 0.05, "nothing established").when(F.col("b_only") > F.col("a_only"), "second better").otherwise("first better")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


