"""BM25 over one or many corpora, all queries at once; sources/postings.py has it over a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6


def term_counts(tokens: Column | str) -> Column:
    """The distinct tokens of a row with their counts, as structs (token, tf), from one sort of the row's own tokens."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf"))))

    def bound(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) > 0, bound(F.sort_array(t), counted)).otherwise(F.array().cast("array<struct<token:string,tf:int>>"))


def postings(docs: DataFrame) -> DataFrame:
    """docs (corpus, doc, tokens) to (corpus, doc, dl, token, tf), without a shuffle: a document is one row."""
    rows = docs.select("corpus", "doc", F.size("tokens").alias("dl"), F.explode(term_counts("tokens")).alias("p"))
    return rows.select("corpus", "doc", "dl", "p.token", "p.tf").where("token is not null")  # so that all uses have the same plan


def bm25(docs: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query, corpus, doc, score) of every pair with a token in common.

    docs: (corpus, doc, tokens); queries: (query, corpus, tokens). A repeated query token counts again. A negative idf
    becomes epsilon times the mean idf of the corpus' vocabulary. Scores are rounded, so that ties are ties everywhere.

    Texts are tokenized twice: for the vocabulary, of which a row for each token and task is shuffled, and for the scores,
    which are summed up where the document is. Query terms are broadcast as far as Spark's own size limit allows, else
    joined by token.
    """
    tf = postings(docs)
    vocabulary = tf.groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    n = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    raw = vocabulary.join(n, "corpus")
    raw = raw.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    size = raw.groupBy("corpus").agg((F.sum("ctf") / F.max("n")).alias("avgdl"), F.avg("idf").alias("mean_idf"))
    wanted = queries.select("query", "corpus", F.explode("tokens").alias("token")).groupBy("query", "corpus", "token").agg(F.count(F.lit(1)).alias("qtf"))
    # ctf is asked for again so that both uses of the vocabulary are one and the same shuffle.
    terms = wanted.join(raw.where("ctf > 0").select("corpus", "token", "idf"), ["corpus", "token"]).join(size, "corpus")
    terms = terms.select("query", "corpus", "token", "avgdl", (F.col("qtf") * F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))).alias("weight"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(terms, ["corpus", "token"]).groupBy("query", "corpus", "doc").agg(F.round(F.sum(part), DIGITS).alias("score"))


def best_chunk(scored: DataFrame) -> DataFrame:
    """(query, corpus, path, pos, score) to a row for each path: its best score and the earliest chunk that has it."""
    best = F.max(F.struct("score", (-F.col("pos")).alias("p")))
    return scored.groupBy("query", "corpus", "path").agg(best.alias("b")).select("query", "corpus", "path", F.col("b.score").alias("score"), (-F.col("b.p")).alias("pos"))
