"""Vector code compression: vectors as integers, cut into parts, each part told by the number of its nearest codebook entry.

Codebooks are broadcast each round (parts x entries x part length integers). Arrow batches take the squared distances of all
parts to all entries at once, as |x|^2 - 2 x.c + |c|^2 with exact int64 matrix products, and the first of the smallest.
Each task adds up its vectors by part and entry; these sums (parts x entries rows a task) are merged by a grouped shuffle
and alone come to the driver. Vectors themselves never move but for the last join with their label's error.

Defined results: a vector is dropped if it is null or empty, holds a null, NaN or infinite component, or differs in length
from that of the smallest kept id; the length must be a multiple of the number of parts. Vectors so
large that a distance may pass 2^62 (components over 32,768 with 64 of them) are refused with an error. A null id is kept but begins no codebook; of vectors that share an
id among the first ones the smallest, component by component, begins it; with fewer ids than entries there are fewer
entries. Repeated rows count as often as they occur; ties go to the lower entry; an empty table gives an empty table;
further columns are ignored but for those asked for with keep, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import HOT_SHARE, mapped, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: No squared distance may pass this, so that sums of products stay exact 64-bit integers.
LARGEST = 1 << 62
#: Vectors that are compared at once.
BLOCK = 4096


def whole(column: pa.Array, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, integers) of the vectors that are kept."""
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten()  # nulls have no components
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.flatnonzero((sizes == length) & (bad[first[1:]] == bad[first[:-1]])) if length and n else np.zeros(0, np.int64)
    return kept, integers(flat[(first[kept][:, None] + np.arange(length or 0)).ravel()].reshape(len(kept), length or 0))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of vectors with finite components, which are the rows of x."""
    x = np.floor(x * SCALE)
    if x.size and x.shape[1] * (2 * np.abs(x).max()) ** 2 > LARGEST:
        raise ValueError("a component is so large that distances would not be exact")
    return x.astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each vector: books is parts x entries x part length."""
    parts, _, width = books.shape
    entry, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    norms = (books * books).sum(2)
    for a in range(0, len(x), BLOCK):
        for p in range(parts):
            part = x[a : a + BLOCK, p * width : (p + 1) * width]
            d = (part * part).sum(1)[:, None] - 2 * (part @ books[p].T) + norms[p]
            best = d.argmin(1)  # the first of equal ones
            entry[a : a + BLOCK, p] = best
            error[a : a + BLOCK, p] = d[np.arange(len(d)), best]
    return entry, error


def _seeds(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first codebooks; None without any vector that has an id."""
    def kept(rows: DataFrame) -> DataFrame:
        nan = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~nan)

    ok = kept(vectors)
    first = ok.orderBy("id", "v").select(F.size("v")).limit(1).collect()
    if not first:
        return None
    ok = ok.where(F.size("v") == first[0][0])
    ids = [r[0] for r in ok.select("id").distinct().orderBy("id").limit(entries).collect()]
    rows = ok.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).collect()
    x = integers(np.array([r[1] for r in sorted(rows)], float))
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components cannot be cut into {parts} equal parts")
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def _improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            _, x = whole(batch.column(1), parts * width)
            slot = nearest(x, books)[0] + np.arange(parts) * entries
            counts += np.bincount(slot.ravel(), minlength=parts * entries)
            np.add.at(sums, slot.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, j]) for j in range(width))], ["slot", "n", *(f"s{j}" for j in range(width))])

    names = [f"s{j}" for j in range(width)]
    each = mapped(vectors, run, "slot long, n long, " + ", ".join(f"{c} long" for c in names))
    # Sums of many tasks may pass 64 bits.
    merged = each.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect()
    out = books.copy()
    for row in merged:
        out[row["slot"] // entries, row["slot"] % entries] = [int(row[c]) // row["n"] for c in names]
    sent.destroy()
    return out


def train(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks, parts x entries x part length integers; None without any vector that has an id."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits an entry: 1 to 256 entries")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    books = _seeds(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = _improved(rows, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, *, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns of keep, `code` (two hex digits a part) and `error` (the squared distance) of every vector that is kept."""
    rows = vectors.select(F.col(vector).alias("v"), *(F.col(f"`{c}`") for c in keep))
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = rows.drop("v").schema.add("code", "string").add("error", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            kept, x = whole(batch.column(0), books.shape[0] * books.shape[2] if books is not None else None)
            if not len(kept):
                continue
            entry, error = nearest(x, books)
            code = digits[entry[:, 0]]
            for p in range(1, entry.shape[1]):
                code = np.char.add(code, digits[entry[:, p]])
            rest = batch.take(pa.array(kept)).columns[1:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(code.astype(object), pa.string()), pa.array(error.sum(1))], names)

    return mapped(rows, run, schema)


def decode(codes: DataFrame, books: np.ndarray, *, code: str = "code") -> DataFrame:
    """codes with `vector`: the entries that a code names, as numbers again."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(int(v) / SCALE) for v in entry)) for entry in book)) for book in books))
    part = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(F.get(flat, F.lit(p)), part(p)) for p in range(len(books)))))


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all integers of the codebooks, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def with_label_error(rows: DataFrame, *, label: str = "label") -> DataFrame:
    """rows with `label_error`: error summed over equal labels, nulls together.

    Labels with more than one of HOT_SHARE rows are fewer than HOT_SHARE: these are broadcast, the others joined by shuffle.
    """
    rows = staged(rows, "codes")
    total = rows.count()
    sums = rows.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    sums = staged(sums.select(F.col(label).alias("_label"), "label_error", (F.col("_n") * HOT_SHARE > total).alias("_hot")), "sums")
    same = F.col(label).eqNullSafe(F.col("_label"))
    hot = rows.join(F.broadcast(sums.where("_hot").withColumnRenamed("label_error", "_here")), same, "left").drop("_label")
    here = hot.where("_hot").select(*rows.columns, F.col("_here").alias("label_error"))
    there = hot.where("_hot is null").select(*rows.columns).join(sums.where("not _hot"), same).select(*rows.columns, "label_error")
    return here.unionByName(there)


def op12(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors)
    rows = with_label_error(encode(vectors, books, keep=("vec_id", "label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS y FROM k, range({PARTS}) AS t(p))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p, e, y AS c FROM v JOIN s USING (r))",
    ]
    distance = "list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, y, min(struct_pack(d := {distance}, e := e)) AS m FROM v JOIN b{i} USING (p) GROUP BY r, p, y)")
        if i < ROUNDS:
            sums = f"SELECT p, m.e AS e, j, floor_of(sum(y[j]), count(*)) AS g FROM a{i}, range(1, 1025) AS t(j) WHERE j <= len(y) GROUP BY p, m.e, j"
            steps.append(f"n{i} AS (SELECT p, e, list(g ORDER BY j) AS c FROM ({sums}) GROUP BY p, e)".replace("floor_of(sum(y[j]), count(*))", "((sum(y[j]) - ((sum(y[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"))
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (p, e))")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h\n"


ORACLE = _oracle()
