"""The dataset: the five columns that may be read, the filter by patch, and the report on what was dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankeval.functions.patches import MAX_FILES, changed_files, drop_reason, source_files
from rankeval.functions.stats import ratio
from rankeval.functions.text import valid_sha

#: The only columns that are read; hints and test patches would leak the answer.
FIELDS = ("instance_id", "repo", "base_commit", "problem_statement", "patch")


def rows(spark: SparkSession, root: str, dataset: str, revision: str, split: str) -> DataFrame:
    """A local export, its revision part of the path."""
    return spark.read.parquet(f"{root.rstrip('/')}/{dataset}/{revision}/{split}").select(*FIELDS)


def classified(raw: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """raw with `files` (distinct source files of the patch) and `reason` (null for rows that stay)."""
    return raw.select(*FIELDS).withColumn("files", source_files(changed_files("patch"))).withColumn("reason", drop_reason(F.col("files"), max_files))


def instances(raw: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The rows that stay; one with an id, repo or commit that is none fails."""
    kept = classified(raw, max_files).where("reason is null")
    fine = valid_sha("base_commit") & (F.length("instance_id") > 0) & (F.length("repo") > 0)
    return kept.select(F.when(fine, F.col("instance_id")).otherwise(F.raise_error(F.concat(F.lit("not an instance: "), F.coalesce("instance_id", F.lit("null"))))).alias("instance_id"), "repo", "base_commit", F.col("problem_statement").alias("issue_text"), F.col("files").alias("ground_truth_files"))


def load_report(classified_rows: DataFrame) -> DataFrame:
    """total, kept, dropped, filter_rate, and a column for each reason; 0 for no rows."""
    r = F.col("reason")
    total, dropped = F.count(F.lit(1)), F.count_if(r.isNotNull())
    return classified_rows.agg(total.alias("total"), F.count_if(r.isNull()).alias("kept"), F.round(ratio(dropped, total), 6).alias("filter_rate"), F.count_if(r == "no_source_files").alias("no_source_files"), F.count_if(r == "too_many_source_files").alias("too_many_source_files"))
