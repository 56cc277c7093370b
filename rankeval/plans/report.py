"""Text of reports from small result rows, and the log that keeps the newest entry first."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "# Results\n"


def duration(seconds: float) -> str:
    m, s = divmod(int(seconds), 60)
    return f"{m}m {s:02d}s" if m else f"{s}s"


def group_line(groups: list) -> str:
    """Groups by size, then name, each by the last part of its name."""
    return " · ".join(f"{g['group'].split('/')[-1]} {g['n']} @ {g['top_1']:.1%}" for g in sorted(groups, key=lambda g: (-g["n"], g["group"])))


def entry(run: dict, total: dict, groups: list, stops: dict[str, int], wall_s: float, note: str = "") -> str:
    """One block of the log. run: rung, split, date, sha, command; total: a row of measures()."""
    dirty = "\n> Uncommitted changes were present.\n" if run["sha"].endswith("-dirty") else ""
    table = [
        ("Top-1", f"{total['top_1']:.1%} (95% CI {total['ci_low']:.1%}-{total['ci_high']:.1%})"), ("Recall@3", f"{total['recall_3']:.1%}"), ("Recall@5", f"{total['recall_5']:.1%}"),
        ("Instances", str(total["n"])), ("Wall clock", duration(wall_s)), ("Cost", f"${total['cost_total']:.2f} (${total['cost_each']:.4f} each)"),
    ]
    rows = "\n".join(f"| {k} | {v} |" for k, v in table)
    ends = ", ".join(f"{k} {v}" for k, v in sorted(stops.items()))
    return f"## {run['date']} · {run['rung']} · {run['split']}\n{dirty}\n| Metric | Value |\n|---|---|\n{rows}\n\nBy group: {group_line(groups)}\n\nStops: {ends}\n\nCode `{run['sha']}`, `{run['command']}`\n\n{note or 'No reading recorded.'}\n"


def prepended(log: str, block: str) -> str:
    """log with block right below its header; nothing is lost."""
    body = log[len(HEADER) :].lstrip("\n") if log.startswith(HEADER) else log
    return f"{HEADER}\n{block}" + (f"\n{body}" if body else "")


def comparison(c: dict, a: str, b: str) -> str:
    """Text of a compared() row with its verdict."""
    end = {
        "nothing to test": f"{a} and {b} agree on every row.",
        "nothing established": f"Nothing is established: {c['b_only']} against {c['a_only']}, p={c['p_value']:.4g}.",
        "second better": f"{b} beats {a} on {c['b_only']} rows and loses {c['a_only']}, p={c['p_value']:.4g}.",
        "first better": f"{a} beats {b} on {c['a_only']} rows and loses {c['b_only']}, p={c['p_value']:.4g}.",
    }[c["verdict"]]
    return f"{b} against {a}, n={c['n']}, delta {c['delta']:+.1%}, both right {c['both_hit']}, both wrong {c['both_miss']}. {end}"


def notes(counts: dict[str, int], reaches_past_list: bool) -> str:
    """What a run has to admit; zero counts are left out. Off-list paths degrade a run only where it may not leave its list."""
    words = {"unparseable": "unparseable replies", "truncated": "truncated replies", "no_candidates": "rows without candidates", "unknown_tools": "calls to unknown tools"} | ({} if reaches_past_list else {"off_list": "off-list paths"})
    told = [f"{counts[k]} {v}" for k, v in words.items() if counts.get(k)]
    out = [f"Degraded: {', '.join(told)}."] if told else []
    if reaches_past_list:
        out.append(f"Guardrail: {counts.get('hallucinated', 0)} paths do not exist, {counts.get('guardrail_retries', 0)} retries; {counts.get('off_list', 0)} off-list accepted, {counts.get('recalled', 0)} of them never surfaced by a tool.")
    if counts.get("cache_hits"):
        out.append(f"{counts['cache_hits']} replies came from the cache.")
    return " ".join(out)


def parse_log(spark: SparkSession, text: str) -> DataFrame:
    """(place, run_date, rung, split, top_1, n, cost): a row for each entry of a log, the newest first."""
    blocks = [(i, b) for i, b in enumerate(re.split(r"(?m)^## ", text)[1:])]
    df = spark.createDataFrame(blocks or [(0, "")], "place int, block string").where("block != ''")
    get = lambda p, kind="string": F.nullif(F.regexp_extract("block", p, 1), F.lit("")).cast(kind)
    return df.select("place", get(r"^(\S+) ·").alias("run_date"), get(r"^\S+ · (.+?) ·").alias("rung"), get(r"^\S+ · .+? · (\S+)").alias("split"), get(r"Top-1 \| ([0-9.]+)%", "double").alias("top_1"), get(r"Instances \| (\d+)", "int").alias("n"), get(r"Cost \| \$([0-9.]+)", "double").alias("cost"))


def newest(entries: DataFrame, key: str = "rung") -> DataFrame:
    """The entry of each rung that stands first."""
    w = Window.partitionBy(key).orderBy("place")
    return entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def today() -> str:
    return datetime.date.today().isoformat()
