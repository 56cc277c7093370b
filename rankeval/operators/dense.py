"""Dense retrieval: exact dot products of query vectors with all vectors, and a vector index that grows by what is new."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankeval.operators.heads import HELD, Best
from rankeval.session import ship

DIGITS = 6
#: Bound on the query block that is broadcast, in numbers; more queries go in more blocks.
BLOCK_NUMBERS = 4_000_000
#: Products that a task holds at a time.
CELLS = 1_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double, within the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _blocks(queries: DataFrame, corpus: bool, most: int = BLOCK_NUMBERS) -> Iterator[tuple]:
    """(query, corpus, vectors) of queries in blocks of bounded size, at most so many, as arrays; one empty block without any."""
    block, width, some = [], 1, False
    for row in queries.select("query", *(["corpus"] if corpus else []), "query_embedding").toLocalIterator():
        width = max(1, len(row[-1]))
        block.append(row)
        if len(block) * width >= BLOCK_NUMBERS or len(block) >= most:
            yield _arrays(block)
            block, some = [], True
    if block or not some:
        yield _arrays(block)


def _arrays(block: list) -> tuple:
    return _objects([r[0] for r in block]), _objects([r[1] for r in block]), np.array([r[-1] for r in block], np.float64)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector, their vectors); null vectors are left out, others must be whole and of this width."""
    at = np.flatnonzero(~np.asarray(column.is_null()))
    column = column.take(pa.array(at))
    if len(at) and set(column.value_lengths().to_pylist()) != {width} or column.flatten().null_count:
        raise ValueError(f"a vector is not {width} numbers long")
    return at, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k nearest of all vectors (id, embedding) for each query (query, query_embedding).

    Query blocks of bounded size are broadcast; each task gives at most k candidates a query, from matrix products of at most
    CELLS numbers, so what is held and shuffled does not grow with the number of vectors in a task. Rows without a vector
    are left out; a vector of another length is an error. Ids and queries keep their types.
    """
    ship(vectors.sparkSession)
    rows, out = vectors.select("id", "embedding"), None
    types = [queries.schema["query"].dataType, rows.schema["id"].dataType]
    schema = f"query {types[0].simpleString()}, id {types[1].simpleString()}, score double"
    for block in _blocks(queries, False, max(1, HELD // k)):
        sent = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, _, q = sent.value
            kinds = [to_arrow_type(t) for t in types]
            best = Best(k, len(names), merged=False)
            for batch in batches:
                at, v = _matrix(batch.column(1), q.shape[1]) if len(names) else ([], None)
                step = max(1, CELLS // max(1, len(names)))
                for i in range(0, len(at), step):
                    ids = batch.column(0).take(pa.array(at[i : i + step]))
                    best.add(ids, pa.array(np.zeros(len(ids), np.int64)), np.round(v[i : i + step] @ q.T, DIGITS))
            for t in best.tables():
                query = pa.array(names.tolist(), kinds[0]).take(t.column("q").combine_chunks())
                yield from pa.table([query, t.column("doc").cast(kinds[1]), t.column("score")], ["query", "id", "score"]).combine_chunks().to_batches(10_000)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, path, score, pos): for each query and path the best of the path's vectors (path, pos, embedding), the first of equals.

    Where both tables have a corpus, a query meets the vectors of its own corpus alone. Queries go out in blocks of bounded
    size and meet a batch in products of at most CELLS numbers; a batch of vectors gives a row for each of its paths and query,
    so what is shuffled is smaller than all pairs by the number of vectors that a path has in a batch. Vectors and types are treated as in top_k().
    """
    ship(vectors.sparkSession)
    corpus = "corpus" in vectors.columns and "corpus" in queries.columns
    rows = vectors.select("path", F.col("pos").cast("long").alias("pos"), "embedding", *(["corpus"] if corpus else []))
    types, out = [queries.schema["query"].dataType, rows.schema["path"].dataType], None
    schema = f"query {types[0].simpleString()}, path {types[1].simpleString()}, score double, pos bigint"
    for block in _blocks(queries, corpus):
        sent = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, own, q = sent.value
            kinds = [to_arrow_type(t) for t in types]
            asked, own = pa.array(names.tolist(), kinds[0]), pa.array(own.tolist()) if corpus else None
            for batch in batches:
                at, v = _matrix(batch.column(2), q.shape[1]) if len(names) else ([], None)
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                keys = ["corpus", "path", "pos"] if corpus else ["path", "pos"]
                order = np.asarray(pc.sort_indices(pa.table({c: part.column(part.schema.get_field_index(c)) for c in keys}), [(c, "ascending") for c in keys]))
                part, v = part.take(pa.array(order)), v[order]
                paths, pos = part.column(0), part.column(1).to_numpy()
                code = np.asarray(paths.dictionary_encode().indices)
                edge, group = code[1:] != code[:-1], None
                if corpus:
                    both = pa.concat_arrays([part.column(3), own.cast(part.column(3).type)]).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    group, mine = both[: len(pos)], both[len(pos) :]
                    edge |= group[1:] != group[:-1]
                first = np.flatnonzero(np.concatenate([[True], edge]))
                place = np.arange(len(pos))
                # Both queries and paths are dealt out so that no product is larger; of a path in two slices two rows are given.
                for a in range(0, len(pos), CELLS):
                    z = min(len(pos), a + CELLS)
                    step = max(1, CELLS // (z - a))
                    heads = np.unique(np.concatenate([[a], first[(first > a) & (first < z)]])) - a
                    width = np.diff(np.append(heads, z - a))
                    for i in range(0, len(names), step):
                        near = np.round(q[i : i + step] @ v[a:z].T, DIGITS)
                        most = np.maximum.reduceat(near, heads, axis=1)
                        at = np.minimum.reduceat(np.where(near == np.repeat(most, width, axis=1), place[: z - a], z), heads, axis=1)  # the first of equals
                        x, y = np.nonzero(mine[i : i + step, None] == group[a + heads]) if corpus else np.divmod(np.arange(most.size), len(heads))
                        found = a + at[x, y]
                        for j in range(0, len(x), 100_000):
                            u, w = x[j : j + 100_000], found[j : j + 100_000]
                            yield pa.RecordBatch.from_arrays([asked.take(pa.array(i + u)), paths.take(pa.array(w)).cast(kinds[1]), pa.array(most[u, y[j : j + 100_000]]), pa.array(pos[w])], ["query", "path", "score", "pos"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", (-F.col("pos")).alias("p")))
    return out.groupBy("query", "path").agg(best.alias("b")).select("query", "path", F.col("b.score").alias("score"), (-F.col("b.p")).alias("pos"))


def extend_index(tree: DataFrame, index: DataFrame | None, chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(blob, pos, embedding) rows for the chunks of blobs that the tree holds and the index does not; unit length.

    tree: (blob, ...); chunks: (blob, pos, text). encode takes texts and gives a row for each; it is called in batches.
    """
    ship(tree.sparkSession)
    new = tree.select("blob").distinct()
    if index is not None:
        new = new.join(index.select("blob").distinct(), "blob", "left_anti")
    todo = chunks.join(new, "blob", "left_semi").select("blob", "pos", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                v = np.asarray(encode(own["text"].tolist()), np.float32)
                v = v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))
                yield pd.DataFrame({"blob": own["blob"].to_numpy(), "pos": own["pos"].to_numpy(), "embedding": list(v)})

    return todo.mapInPandas(run, f"blob {tree.schema['blob'].dataType.simpleString()}, pos int, embedding array<float>")


def hashed_encoder(dims: int = 32) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: counts of hashed words. For tests and dry runs."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, zlib.crc32(w.encode()) % dims] += 1
        return out

    return encode
