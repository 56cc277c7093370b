"""Replies that were made before: looked up by a digest of everything that shapes a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 over the parts as a JSON list; parts that are not text keep their form. Null parts are null in the list."""
    quoted = [F.coalesce(F.to_json(F.array(F.col(p) if isinstance(p, str) else p)), F.lit("[null]")) for p in parts]
    return F.sha2(F.concat_ws(",", *quoted).cast("binary"), 256)


def agent_key(messages: Column | str, tools: Column | str) -> Column:
    """The key of an agent's step: the whole transcript and the schemas of the tools that were on offer.

    messages: array of (type, content, tool_calls, tool_call_id); tools: array of schemas as text. A null in a message is as
    an empty text or list; with other tools the same transcript is another question. The word in front keeps these keys
    apart from those of plain replies.
    """
    m = F.transform(messages, lambda x: F.struct(*(F.coalesce(x[c], F.lit("")).alias(c) for c in ("type", "content", "tool_call_id")), F.coalesce(x["tool_calls"].cast("string"), F.lit("[]")).alias("tool_calls")))
    return F.sha2(F.concat_ws("\n", F.lit("agent"), F.to_json(m), F.coalesce(F.to_json(tools), F.lit("[]"))).cast("binary"), 256)


def step_key(messages: Column | str, tools: Column | str, *, model: Column | str, provider: Column | str, reasoning: Column | str, max_tokens: Column | str) -> Column:
    """The key under which an agent's reply is stored: the question, and all of the model's setting that shapes the answer."""
    return cache_key(model, provider, reasoning, max_tokens, agent_key(messages, tools))


def lookup(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with the reply of the same `key` and `cached`. A reply that is not whole (null text) is a miss."""
    known = responses.where(F.col("text").isNotNull()).groupBy("key").agg(F.max(F.struct("text", "cost")).alias("r"))
    return requests.join(known, "key", "left").select(*requests.columns, F.col("r.text").alias("text"), F.col("r.cost").alias("cost"), F.col("r").isNotNull().alias("cached"))


def counters(replies: DataFrame) -> DataFrame:
    """One row over (cached, cost, finish_reason, off_list, unparseable): cached replies cost nothing now."""
    live = ~F.col("cached")
    return replies.agg(
        F.count_if(live).alias("calls"), F.count_if("cached").alias("cache_hits"), F.round(F.coalesce(F.sum(F.when(live, F.col("cost"))), F.lit(0.0)), 6).alias("spent"),
        F.count_if("unparseable").alias("unparseable"), F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.coalesce(F.sum("off_list"), F.lit(0)).cast("long").alias("off_list"),
    )
