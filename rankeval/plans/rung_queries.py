"""The ladder as registered queries: every part is a Python source file, every fiftieth an issue about its type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.operators import ranking
from rankeval.plans import rungs
from rankeval.plans.base import Tables, query, sql_bm25, sql_tokens
from rankeval.plans.text_queries import python_sources

#: Files that have vectors, several each: every scale has as many parts.
EMBEDDED = 200
SHOWN = 10


def _tables(t: Tables) -> dict:
    corpus = F.lit("all").alias("corpus")
    path = lambda c: F.concat(F.lit("src/f"), c.cast("string"), F.lit(".py")).alias("path")
    asked = t.part.where("p_partkey % 50 = 0")
    v, number = t.embeddings, F.col("vec_id") % EMBEDDED + 1
    vectors = t.embeddings.select(F.col("vec_id").alias("of"), F.col("embedding").alias("query_embedding"))
    return {
        "store": t.store("ladder", t.part),
        "files": t.part.select(corpus, path(F.col("p_partkey")), F.col("p_partkey").alias("blob")),
        "blobs": python_sources(t),
        "queries": asked.select(F.col("p_partkey").alias("query"), corpus, F.concat("p_type", F.lit(" wraps x"), F.col("p_size").cast("string")).alias("text")),
        "vectors": v.select(corpus, path(number), F.floor(F.col("vec_id") / EMBEDDED).cast("int").alias("pos"), "embedding"),
        "query_vectors": asked.select(F.col("p_partkey").alias("query"), corpus, (F.col("p_partkey") % 500).alias("of")).join(vectors, "of").select("query", "corpus", "query_embedding"),
    }


def _shown(ranking: DataFrame) -> DataFrame:
    return ranking.where(F.col("rank") <= SHOWN).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


_PATH = "'src/f' || p_partkey || '.py'"
_PATH_TOKENS = f"list_concat({sql_tokens(_PATH)}, [lower({_PATH})])"
_CLASS, _METHOD = "'C' || p_partkey", "'C' || p_partkey || '.m' || p_size"
_CLASS_HEAD = f"'class ' || {_CLASS} || '(Base)' || chr(10) || p_type"
_METHOD_HEAD = f"'def ' || {_METHOD} || '(self, a: int=1) -> str'"
_CLASS_BODY = f"chr(10) || 'class ' || {_CLASS} || '(Base):' || chr(10) || '    ' || repeat('\"', 3) || p_type || repeat('\"', 3) || chr(10) || '    x = ' || p_size || chr(10) || '    @wraps'"
_METHOD_BODY = "chr(10) || '    async def m' || p_size || '(self, a: int=1) -> str:' || chr(10) || '        return a'"
_FILE = f"'class ' || {_CLASS} || '(Base):' || chr(10) || '    ' || repeat('\"', 3) || p_type || repeat('\"', 3) || chr(10) || '    x = ' || p_size || chr(10) || '    @wraps' || chr(10) || '    async def m' || p_size || '(self, a: int=1) -> str:' || chr(10) || '        return a' || chr(10) || 'if x:' || chr(10) || '    def hidden(): pass' || chr(10)"
_ISSUES = f"SELECT p_partkey AS query, {sql_tokens(chr(39) + chr(39) + ' || p_type || ' + chr(39) + ' wraps x' + chr(39) + ' || p_size')} AS toks FROM part WHERE p_partkey % 50 = 0"


def _sql_chunks(bodies: bool) -> str:
    parts = [(f"{_CLASS_HEAD}" + (f" || {_CLASS_BODY}" if bodies else ""), 0), (f"{_METHOD_HEAD}" + (f" || {_METHOD_BODY}" if bodies else ""), 1)]
    return " UNION ALL ".join(f"SELECT ({_PATH}, {pos}) AS doc, list_concat({_PATH_TOKENS}, {sql_tokens('(' + text + ')')}) AS toks FROM part" for text, pos in parts)


def _sql_by_chunks(bodies: bool) -> str:
    """CTEs that end in lex(query, doc, score, rank), all files."""
    return f"""{sql_bm25(_sql_chunks(bodies), _ISSUES)},
b AS (SELECT q.query, d.doc[1] AS doc, max(coalesce(s.score, 0.0)) AS score FROM q CROSS JOIN d LEFT JOIN s ON s.query = q.query AND s.doc = d.doc GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b)"""


_SQL_DENSE = f"""v AS (SELECT 'src/f' || (vec_id % {EMBEDDED} + 1) || '.py' AS doc, embedding::DOUBLE[] AS e FROM embeddings),
qv AS (SELECT p_partkey AS query, embedding::DOUBLE[] AS e FROM part JOIN embeddings ON vec_id = p_partkey % 500 WHERE p_partkey % 50 = 0),
best AS (SELECT query, doc, max(round(list_inner_product(qv.e, v.e), 6)) AS score FROM qv, v GROUP BY ALL),
den AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM best)"""
_SHOW = f"SELECT query, doc, score, rank::BIGINT AS rank FROM {{}} WHERE rank <= {SHOWN}"


@query(f"""WITH {sql_bm25(f"SELECT {_PATH} AS doc, list_concat({_PATH_TOKENS}, {sql_tokens('(' + _FILE + ')')}) AS toks FROM part", _ISSUES)},
r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT q.query, d.doc, coalesce(s.score, 0.0) AS score FROM q CROSS JOIN d LEFT JOIN s ON s.query = q.query AND s.doc = d.doc)) {_SHOW.format('r')}""")
def rung_bm25(t: Tables) -> DataFrame:
    return _shown(rungs.RUNGS["bm25"](_tables(t), SHOWN))


@query(f"WITH {_sql_by_chunks(False)} {_SHOW.format('lex')}")
def rung_bm25_chunks(t: Tables) -> DataFrame:
    return _shown(rungs.RUNGS["bm25-chunks"](_tables(t), SHOWN))


@query(f"WITH {_sql_by_chunks(True)} {_SHOW.format('lex')}")
def rung_bm25_chunks_bodies(t: Tables) -> DataFrame:
    return _shown(rungs.RUNGS["bm25-chunks-bodies"](_tables(t), SHOWN))


@query(f"WITH {_SQL_DENSE} {_SHOW.format('den')}")
def rung_embed(t: Tables) -> DataFrame:
    return _shown(rungs.RUNGS["embed"](_tables(t), SHOWN))


_SQL_HYBRID = f"""{_sql_by_chunks(True)}, {_SQL_DENSE},
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM lex UNION ALL SELECT query, doc, rank FROM den) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f)"""


@query(f"WITH {_SQL_HYBRID} {_SHOW.format('h')}")
def rung_hybrid(t: Tables) -> DataFrame:
    """Chunk bodies and vectors, fused by reciprocal ranks."""
    return _shown(rungs.RUNGS["hybrid"](_tables(t), SHOWN))


def _sql_filled(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in values.items():
        out = out.replace(f"{{{mark}}}", f"' || {value} || '")
    return out.replace("\n", "' || chr(10) || '")


_ISSUE = "p_type || ' wraps x' || p_size"
_SQL_SNIPPETS = f"""ct AS (SELECT {_PATH} AS doc, 0 AS pos, {_CLASS_HEAD} || {_CLASS_BODY} AS snippet FROM part UNION ALL SELECT {_PATH}, 1, {_METHOD_HEAD} || {_METHOD_BODY} FROM part),
bc AS (SELECT q.query, d.doc[1] AS doc, d.doc[2] AS pos, row_number() OVER (PARTITION BY q.query, d.doc[1] ORDER BY coalesce(s.score, 0.0) DESC, d.doc[2]) AS r FROM q CROSS JOIN d LEFT JOIN s ON s.query = q.query AND s.doc = d.doc),
pr AS (SELECT l.query, count(*)::BIGINT AS n, string_agg('### ' || l.doc || chr(10) || snippet, chr(10) || chr(10) ORDER BY l.rank) AS candidates FROM lex l JOIN bc ON bc.query = l.query AND bc.doc = l.doc AND bc.r = 1 JOIN ct ON ct.doc = bc.doc AND ct.pos = bc.pos WHERE l.rank <= {ranking.HEAD} GROUP BY l.query)"""
_RERANK_SQL = _sql_filled(ranking.RERANK_TEMPLATE, n="n", issue=f"({_ISSUE})", candidates="candidates")
_AGENT_SQL = _sql_filled(ranking.AGENT_TEMPLATE, n="n", calls="5", submit="'hand_in'", issue=f"({_ISSUE})", candidates="candidates")


@query(f"""WITH {_sql_by_chunks(True)}, {_SQL_SNIPPETS} SELECT query, n, sha256({_RERANK_SQL}) AS rerank_sha256, length({_RERANK_SQL})::BIGINT AS rerank_chars, sha256({_AGENT_SQL}) AS agent_sha256 FROM pr JOIN part ON p_partkey = query""")
def rung_prompts(t: Tables) -> DataFrame:
    """What a model and an agent are asked about the first of the chunk ranking, each with its best chunk."""
    tables = _tables(t)
    base = rungs.RUNGS["bm25-chunks-bodies"](tables, ranking.HEAD)
    asked, agents = rungs.rerank_prompts(tables, base), rungs.agent_prompts(tables, base, 5, "hand_in")
    agents = agents.select("query", F.sha2("prompt", 256).alias("agent_sha256"))
    return asked.join(agents, "query").select("query", "n", F.sha2("prompt", 256).alias("rerank_sha256"), F.length("prompt").cast("long").alias("rerank_chars"), "agent_sha256")
