"""The ladder of rankers: each takes tables and gives (query, doc, rank, score) for all queries at once.

Tables: files (corpus, path, blob), blobs (blob, text), queries (query, corpus, text); dense rankers take vectors
(corpus, path, pos, embedding) and query_vectors (query, corpus, query_embedding). With "store", a folder, chunks and
term counts are kept there from run to run: only blobs that it lacks are parsed, and ranking reads no text. With k the
lexical rankers give the first k without summing up all that match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.functions.text import is_source, tokenize, tokenize_path
from rankeval.operators import agent, chunking, dense, ranking
from rankeval.sources import postings, store
from rankeval.sources.chunks import Chunks
from rankeval.sources.postings import Postings, ready

#: Up to this rank reciprocal ranks differ after rounding.
DISTINCT_RANKS = 10_000


def _queries(t: dict[str, DataFrame]) -> DataFrame:
    return t["queries"].select("query", "corpus", tokenize("text").alias("tokens"))


def _sources(t: dict[str, DataFrame]) -> DataFrame:
    return t["files"].where(is_source("path"))


def _store(t: dict[str, DataFrame], name: str) -> str:
    """Where an index of these tables is kept: below t["store"], or in a folder of its own for this use alone."""
    spark = t["files"].sparkSession
    return f"{t['store']}/{name}" if "store" in t else f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_index(t: dict[str, DataFrame]) -> Postings:
    """A document is a file: the tokens of its path and its text. Each blob is tokenized once."""
    none = F.array().cast("array<string>")

    def make(new: DataFrame) -> DataFrame:
        words = t["blobs"].join(new.select("blob").distinct(), "blob", "left_semi").select("blob", tokenize("text").alias("words"))
        return new.join(words, "blob", "left").select("corpus", "doc", F.lit(0).alias("pos"), F.concat(tokenize_path("doc"), F.coalesce("words", none)).alias("tokens"))

    return ready(t["files"].sparkSession, _store(t, "files"), _sources(t).select("corpus", F.col("path").alias("doc"), "blob"), make)


def _chunks(t: dict[str, DataFrame], bodies: bool) -> Chunks:
    held = Chunks(t["files"].sparkSession, _store(t, "chunks"), bodies=bodies)
    held.extend(_sources(t), t["blobs"])
    return held


def _chunk_index(t: dict[str, DataFrame], bodies: bool) -> Postings:
    """A document is a file that has a blob, in its chunks, each with the tokens of the path in front."""

    def make(new: DataFrame) -> DataFrame:
        rows = new.join(_chunks(t, bodies).rows().select("blob", "pos", "tokens"), "blob")
        return rows.select("corpus", "doc", "pos", F.concat(tokenize_path("doc"), "tokens").alias("tokens"))

    own = _sources(t).join(t["blobs"].select("blob"), "blob", "left_semi")
    return ready(t["files"].sparkSession, _store(t, "bodies" if bodies else "heads"), own.select("corpus", F.col("path").alias("doc"), "blob"), make)


def _lexical(index: Postings, queries: DataFrame, k: int | None) -> DataFrame:
    """(query, corpus, doc, score, pos, rank): the first k, or with None all documents."""
    if k:
        return index.search(queries, k)
    keys = ["query", "corpus", "doc"]
    matched = index.full(queries)
    below = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"), F.collect_set(F.when(F.col("score") < 0, F.col("pos"))).alias("below"))
    sizes = index.docs().groupBy("corpus", "doc").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    every = queries.select("query", "corpus").join(sizes, "corpus").join(postings.best_chunks(matched), keys, "left").join(below, keys, "left")
    # A chunk without a common token scores 0, which may be more than its document's best match.
    own = (F.col("score") > 0) | (F.col("met") == F.col("chunks"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.coalesce("below", F.array().cast("array<int>"))))
    rows = every.select(*keys, F.when(own, F.col("score")).otherwise(0.0).alias("score"), F.when(own, F.col("pos")).otherwise(free).alias("pos"))
    return ranking.ranked(rows, "query")


def bm25(t: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    return _lexical(_file_index(t), _queries(t), k).select("query", "doc", "rank", "score")


def bm25_chunks(t: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    return _lexical(_chunk_index(t, False), _queries(t), k).select("query", "doc", "rank", "score")


def bm25_chunks_bodies(t: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    return _lexical(_chunk_index(t, True), _queries(t), k).select("query", "doc", "rank", "score")


def embed(t: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    """Queries of the same vector are asked once, and their lists are cut before they are dealt out to them."""
    asked = t["query_vectors"].select("query", "corpus", "query_embedding")
    first = asked.groupBy("corpus", "query_embedding").agg(F.to_json(F.min(F.struct("query", "corpus"))).alias("asked"))
    named = asked.join(first, ["corpus", "query_embedding"]).select("query", "asked")
    best = dense.best_of(t["vectors"], first.withColumnRenamed("asked", "query")).select(F.col("query").alias("asked"), F.col("path").alias("doc"), "score")
    if k:
        best = ranking.ranked(best, "asked").where(F.col("rank") <= k).drop("rank")
    rows = named.join(best, "asked").groupBy("query", "doc").agg(F.max("score").alias("score"))  # of all its corpora
    rows = ranking.ranked(rows, "query").select("query", "doc", "rank", "score")
    return rows.where(F.col("rank") <= k) if k else rows


def hybrid(t: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    """Both lists by reciprocal ranks. Every rank of either list counts.

    With k the files without vectors are taken as far as rank k: behind it they are below k others. Those with vectors come
    with their places in both lists, however far down.
    """
    near = embed(t)
    if k and k <= DISTINCT_RANKS:
        index, queries = _chunk_index(t, True), _queries(t)
        far = index.ranks(queries, t["vectors"].select("corpus", F.col("path").alias("doc")))
        first = index.search(queries, k).select("query", "doc", "rank").unionByName(far.select("query", "doc", "rank")).distinct()
    else:
        first = bm25_chunks_bodies(t).select("query", "doc", "rank")
    lists = first.withColumn("list", F.lit(0)).unionByName(near.select("query", "doc", "rank").withColumn("list", F.lit(1)))
    fused = ranking.rrf(lists)
    return fused.where(F.col("rank") <= k) if k else fused


def reranked(base: DataFrame, scorer: DataFrame, k: int = ranking.HEAD) -> DataFrame:
    """base with its head ordered by an injected scorer's rows (query, doc, rescore)."""
    return ranking.rerank_head(base, scorer, k).select("query", "doc", "rank", "score")


def reply_reranked(base: DataFrame, replies: DataFrame, k: int = ranking.HEAD) -> DataFrame:
    """base with its head in the order of a reply (query, text), the tail as it was."""
    lists = base.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
    r = lists.join(replies.select("query", "text"), "query", "left").withColumn("p", ranking.parsed_reply(F.col("text"), F.slice("docs", 1, k)))
    order = F.concat("p.ranking", F.slice("docs", k + 1, F.greatest(F.lit(1), F.size("docs"))))
    return r.select("query", F.posexplode(order).alias("pos", "doc")).select("query", "doc", (F.col("pos") + 1).alias("rank"))


def cross_encoder(t: dict[str, DataFrame]) -> DataFrame:
    """The fused head by pair_scores (query, doc, rescore), which an injected scorer made of pair_texts()."""
    return reranked(hybrid(t), t["pair_scores"])


def evidence(t: dict[str, DataFrame], base: DataFrame, k: int = ranking.HEAD) -> DataFrame:
    """(query, doc, rank, snippet): the head's paths, each with its best chunk; null where its blob has none."""
    base = base.where(F.col("rank") <= k).select("query", "doc", "rank")
    queries = _queries(t)
    best = _chunk_index(t, True).best(queries, base.join(queries.select("query", "corpus"), "query")).select("query", "corpus", "doc", "pos")
    head = base.join(best, ["query", "doc"], "left")
    blobs = head.join(_sources(t).select("corpus", F.col("path").alias("doc"), "blob"), ["corpus", "doc"], "left")
    chunks = _chunks(t, True).rows().select("blob", "pos", chunking.chunk_text().alias("snippet"))
    return blobs.join(chunks, ["blob", "pos"], "left").select("query", "doc", "rank", "snippet")


def pair_texts(t: dict[str, DataFrame], base: DataFrame, k: int = ranking.HEAD) -> DataFrame:
    """(query, doc, issue, text) for a pair scorer: the head's paths, each with its best chunk, empty parts left out."""
    rows = evidence(t, base, k).join(t["queries"].select("query", F.col("text").alias("issue")), "query")
    return rows.select("query", "doc", "issue", F.array_join(F.filter(F.array("doc", "snippet"), lambda x: x != ""), "\n").alias("text"))


def rerank_prompts(t: dict[str, DataFrame], base: DataFrame, template: str = ranking.RERANK_TEMPLATE, k: int = ranking.HEAD) -> DataFrame:
    """(query, n, prompt): what a model is asked about the head of base."""
    return ranking.prompts(evidence(t, base, k), t["queries"].select("query", F.col("text").alias("issue")), template, k)


def agent_prompts(t: dict[str, DataFrame], base: DataFrame, calls: int = agent.MAX_CALLS, submit: str = "submit_ranking", template: str = ranking.AGENT_TEMPLATE, k: int = ranking.HEAD) -> DataFrame:
    """The same for an agent with so many calls."""
    return ranking.prompts(evidence(t, base, k), t["queries"].select("query", F.col("text").alias("issue")), template, k, calls=F.lit(calls), submit=F.lit(submit))


def rerank_with(model: str | None = None) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """The fused head in the order of a model's replies (query, model, text). Without a name, or of replies without models, there is one model."""

    def run(t: dict[str, DataFrame]) -> DataFrame:
        replies = t["replies"] if model is None or "model" not in t["replies"].columns else t["replies"].where(F.col("model") == model)
        return reply_reranked(hybrid(t), replies)

    return run


def agent_with(cap: int) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Rankings of agents that start from the fused list, replayed from steps with at most cap tool calls each."""

    def run(t: dict[str, DataFrame]) -> DataFrame:
        base = hybrid(t).join(t["queries"].select("query", "corpus"), "query")
        listed = base.groupBy("query", "corpus").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("candidates"))
        done = agent.replay(t["steps"], listed.select(F.col("query").cast("string").alias("instance_id"), "candidates", "corpus"), t["files"].select("corpus", "path"), cap=cap)
        return done.select(F.col("instance_id").alias("query"), F.posexplode("ranking").alias("pos", "doc")).select("query", "doc", (F.col("pos") + 1).alias("rank"))

    return run


#: The recorded models of the named cells.
REPLY_CELLS = {"rerank": "gpt-oss-high", "rerank-gpt-oss-low": "gpt-oss-low", "rerank-deepseek-off": "deepseek-off", "rerank-deepseek-on": "deepseek-on"}
#: Further cells are made by rerank_with(name) and agent_with(cap).
RUNGS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "bm25": bm25, "bm25-chunks": bm25_chunks, "bm25-chunks-bodies": bm25_chunks_bodies, "embed": embed, "hybrid": hybrid, "cross-encoder": cross_encoder,
    **{name: rerank_with(model) for name, model in REPLY_CELLS.items()},
    "agent": agent_with(agent.MAX_CALLS), "agent-no-tools": agent_with(0),
}
