"""Rankings as rows (query, doc, rank): order, fusion, interleaving, head reranking, guardrails, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankeval.functions.text import normalize_path, reply_line

DAMPING = 60
HEAD = 20

#: What a model is asked, around {n} candidates, the {issue} and the rendered {candidates}. Any other text with these marks will do.
RERANK_TEMPLATE = """Order the {n} source files under "Candidates" by how likely the report below asks for a change in them, likeliest first.
Answer with their paths alone, each on its own line.

# Report

{issue}

# Candidates

{candidates}
"""
#: The same for an agent that may call tools {calls} times and hands its answer in by {submit}.
AGENT_TEMPLATE = """Order source files by how likely the report below asks for a change in them, likeliest first. {n} candidates are given; others may be found
with the tools, which may be called {calls} times at most. Hand in the paths by {submit}; all must exist.

# Report

{issue}

# Candidates

{candidates}
"""


def ranked(scored: DataFrame, *keys: str, score: str = "score", doc: str = "doc") -> DataFrame:
    """A unique 1-based rank by score, ties by doc."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), doc)))


def rrf(lists: DataFrame, damping: int = DAMPING) -> DataFrame:
    """lists: (query, list, doc, rank) to (query, doc, score, rank): the sum of 1 / (damping + rank)."""
    fused = lists.groupBy("query", "doc").agg(F.round(F.sum(1 / (damping + F.col("rank"))), 9).alias("score"))
    return ranked(fused, "query")


def interleaved(lists: DataFrame) -> DataFrame:
    """Round robin by position, then by list, repeats skipped: (query, doc, rank)."""
    first = lists.groupBy("query", "doc").agg(F.min(F.struct("rank", "list")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("at"))).drop("at")


def rerank_head(ranking: DataFrame, scores: DataFrame, k: int = HEAD) -> DataFrame:
    """The first k by scores (query, doc, rescore), unscored ones last among them; the tail as it was."""
    head = F.when(F.col("rank") <= k, 0).otherwise(F.col("rank"))
    rows = ranking.join(scores, ["query", "doc"], "left").withColumn("rescore", F.when(F.col("rank") <= k, F.col("rescore")))
    w = Window.partitionBy("query").orderBy(head, F.desc_nulls_last("rescore"), "doc")
    return rows.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))


def hit_at(ranking: Column, truth: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(ranking, 1, k), truth), F.lit(False))


def recall_at(ranking: Column, truth: Column, k: int) -> Column:
    """Share of the distinct truth among the first k, paths compared in normal form; 0 without truth."""
    norm = lambda a: F.array_distinct(F.transform(a, normalize_path))
    t = norm(truth)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(norm(F.slice(ranking, 1, k)), t)) / F.size(t)).otherwise(0.0)


def top1(ranking: Column, truth: Column) -> Column:
    norm = lambda a: F.transform(a, normalize_path)
    return F.coalesce(F.array_contains(norm(truth), normalize_path(F.get(ranking, F.lit(0)))), F.lit(False))


def assembled(answer: Column, candidates: Column) -> Column:
    """The answer's paths, then the candidates it left out: normal forms, no blanks, first mention wins."""
    return F.array_distinct(F.filter(F.transform(F.concat(answer, candidates), normalize_path), lambda p: p != ""))


def guardrail(submitted: DataFrame, tree: DataFrame) -> DataFrame:
    """submitted: (query, corpus, seq, path); tree: (corpus, path). Distinct paths with `exists`, in order of first mention."""
    s = submitted.withColumn("path", normalize_path("path")).where("path != ''").groupBy("query", "corpus", "path").agg(F.min("seq").alias("seq"))
    known = tree.select("corpus", normalize_path("path").alias("path")).distinct().withColumn("known", F.lit(True))
    return s.join(known, ["corpus", "path"], "left").select("query", "corpus", "seq", "path", F.coalesce("known", F.lit(False)).alias("exists"))


def off_list(submitted: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Submitted (query, path) that are not among the candidates (query, path, rank), or among their first k."""
    c = candidates if k is None else candidates.where(F.col("rank") <= k)
    return submitted.join(c.select("query", normalize_path("path").alias("path")).distinct(), ["query", "path"], "left_anti")


def parsed_reply(reply: Column, head: Column) -> Column:
    """Struct of a ranking (known paths in the reply's order, then the rest of head), off_list count and unparseable."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1), reply_line), lambda x: x != "")
    off = F.filter(lines, lambda x: ~F.array_contains(head, x) & (x.contains("/") | x.endswith(".py")))
    found = F.array_distinct(F.filter(lines, lambda x: F.array_contains(head, x)))
    return F.struct(F.when(F.size(found) > 0, F.concat(found, F.array_except(head, found))).otherwise(head).alias("ranking"), F.size(off).alias("off_list"), (F.size(found) == 0).alias("unparseable"))


def rendered_candidates(candidates: Column) -> Column:
    """candidates: an array of structs path, snippet."""
    return F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("### "), c["path"], F.lit("\n"), F.when(F.coalesce(c["snippet"], F.lit("")) != "", c["snippet"]).otherwise("(no snippet available)"))), "\n\n")


def filled(template: str, **values: Column) -> Column:
    """template with its {marks} replaced by values, which are taken as they are: a mark inside a value stays. Null is empty."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(values)
    if unknown:
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*(F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def prompts(head: DataFrame, issues: DataFrame, template: str = RERANK_TEMPLATE, k: int = HEAD, **values: Column) -> DataFrame:
    """(query, n, prompt): the first k of head (query, doc, rank, snippet), rendered in their order into the template with each query's issue (query, issue).

    A query without candidates has no prompt, as nothing is to be asked. Of repeated ranks the smaller path is first.
    """
    shown = head.where(F.col("rank") <= k).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc").alias("path"), "snippet"))).alias("_c"))
    n = F.size("_c").cast("long")
    return shown.join(issues.select("query", "issue"), "query").select("query", n.alias("n"), filled(template, n=n, issue=F.col("issue"), candidates=rendered_candidates(F.col("_c")), **values).alias("prompt"))
