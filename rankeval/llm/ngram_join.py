"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are ordered from rare to frequent (by counts of all documents in a sketch of fixed size). Two sets
of which the larger has n elements are similar only if they share t = ceil(threshold * n) elements, so their prefixes of
n - t + l elements share l. Each document takes the l of least estimated cost: a longer prefix is read by more documents,
but each must match l times before it is verified. The matches are counted where two documents meet alone; at larger
tables one match is enough, which loses nothing and costs verifications.

Verification works at tables. All documents that hold a prefix token in a window of sizes meet at the smallest of them,
the centre; each sends its text there once. At the table a document is kept as its difference from the centre, from which
every pair's overlap follows exactly: |x & y| = |c| - |c - x| - |c - y| + |Dx & Dy|. Only links that join two groups
leave it, at most one a document, so a group of near copies costs rows in proportion to its size. Where links are
counted, every pair of the table is verified and each document's number leaves it; a pair that meets at several centres
is counted at the first, which both documents' lists of centres tell. A table of more than ``table_rows`` is laid out as
pairs of blocks. Equal sets are one node throughout.

Defined results: null, empty and wordless texts have no shingles and are their own component; a text of fewer than k
words is one shingle; rows with the same id and text are alike; null ids are linked like others, but a component's id is
the smallest id that is not null (null if there is none); ties in a prefix go by the shingles' hashes and ties for a
centre by the digest of the set, neither of which changes a result; a very long text is one set, held whole in memory,
and is shuffled whole once for each table that it attends; empty tables give empty tables; columns beyond key and text
are ignored by components() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import NOT_SPACE, Words, chunks, mapped, pieces, raw_texts, staged, table, unstage
from rankeval.llm.components import connected

SKETCH_BITS = 21
SKETCH_PARTS = 64
MAX_MATCHES = 6
#: Cost of verifying a candidate, in posting entries read.
VERIFY_COST = 8.0
TABLE_ROWS = 4000


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's shingles as sorted distinct hashes."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], NOT_SPACE)
        at, h = w.windows(k)
        cut = np.searchsorted(w.doc[at], np.arange(b - a + 1))
        counts = np.diff(w.first)
        short = {j: dict(zip(*(x.tolist() for x in _shorts(w, j)), strict=True)) for j in set(counts[(counts > 0) & (counts < k)].tolist())}
        for i in range(b - a):
            if 0 < counts[i] < k:
                yield np.array([short[counts[i]][w.first[i]]], np.uint64)
            else:
                yield np.unique(h[cut[i] : cut[i + 1]])


def _shorts(w: Words, j: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = w.windows(j)
    own = np.isin(at, w.first[:-1][np.diff(w.first) == j])
    return at[own], h[own]


def least_overlap(n: np.ndarray | int, percent: int):
    """The fewest elements that a set of n shares with any similar set."""
    return -(-percent * n // 100)


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (id, r1, r2, n, node) and, at the end of each task, rows of its counts (part, counts)."""
    names = ["id", "r1", "r2", "n", "node", "part", "counts"]
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in pieces(batches):
            sets = list(shingle_sets(raw_texts(batch.column(3)), k))
            for i in range(0, len(sets), 500):
                counts += np.bincount(_slot(np.concatenate(sets[i : i + 500])), minlength=len(counts)).astype(np.uint32)
            n, key = len(sets), batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(map(len, sets), pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if key is not None:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_PARTS)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, key), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names)

    return mapped(docs, run, f"id {kind}, r1 bigint, r2 bigint, n bigint, node binary, part int, counts binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed counts: 2 ** SKETCH_BITS numbers, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in pieces(batches):
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), np.uint32)
                total[part] = total[part] + x if part in total else x.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.float32)
    for part, counts in mapped(described.where("part is not null").select("part", "counts").repartition("part"), run, "part int, counts binary").collect():
        out[part] = np.frombuffer(counts, np.float32)
    return out.ravel()


def prefix(s: np.ndarray, sketch: np.ndarray, noise: float, percent: int, max_matches: int = MAX_MATCHES) -> tuple[int, np.ndarray]:
    """(matches needed, prefix) of least estimated cost."""
    n = len(s)
    seen = sketch[_slot(s)]
    order = np.lexsort((s, seen))
    base = n - int(least_overlap(n, percent))
    top = min(max_matches, n - base)
    read = np.cumsum(np.maximum(1, seen[order[: base + top]] - noise))[base:]  # entries read for 1, 2, ... matches
    # Documents that match l times are at most the entries read / l (Markov).
    best = int(np.argmin(read * (1 + VERIFY_COST / np.arange(1, top + 1)))) + 1
    return best, s[order[: base + best]]


def _prefixes(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = float(np.median(sent.value)) if len(sent.value) else 0.0
        for batch in pieces(batches):
            n, need, size, tokens = [], [], [0], []
            for s in shingle_sets(raw_texts(batch.column(3)), k):
                best, t = prefix(s, sent.value, noise, percent) if len(s) else (0, s)
                n.append(len(s))
                need.append(best)
                size.append(size[-1] + len(t))
                tokens.append(t.view(np.int64))
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat)], ["r1", "r2", "n", "need", "tokens"])

    return mapped(docs, run, "r1 bigint, r2 bigint, n bigint, need int, tokens array<bigint>")


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Table:
    """The sets that meet at a centre (set 0), kept as their differences from it."""

    def __init__(self, centre: np.ndarray, sets: Iterator[np.ndarray], percent: int):
        sizes, missing, self.diffs, self.percent = [len(centre)], [0], [centre[:0]], percent
        for s in sets:
            lacks, more = np.setdiff1d(centre, s, assume_unique=True), np.setdiff1d(s, centre, assume_unique=True)
            sizes.append(len(s))
            missing.append(len(lacks))
            self.diffs.append(np.concatenate([lacks, more]))
        self.n, self.lacks, self.widths = np.array(sizes), np.array(missing), np.array([len(d) for d in self.diffs])

    def similar(self, i: int, overlap: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether i is similar to each of the sets ``of``, given how much of their differences they share with i's."""
        both = self.n[0] - self.lacks[i] - self.lacks[of] + overlap
        return 100 * both >= self.percent * (self.n[i] + self.n[of] - both)

    @functools.cached_property
    def index(self) -> tuple[np.ndarray, ...]:
        """The differences' elements by number, set after set, and the owners of each."""
        token, where = np.unique(np.concatenate(self.diffs), return_inverse=True)
        order = np.argsort(where, kind="stable")
        owner = np.repeat(np.arange(len(self.n)), self.widths)[order]
        return where, owner, np.searchsorted(where[order], np.arange(len(token) + 1)), np.concatenate([[0], np.cumsum(self.widths)])

    def partners(self, i: int, of: np.ndarray) -> np.ndarray:
        """Those of the sets ``of`` that are similar to i."""
        could = of[self.similar(i, np.minimum(self.widths[i], self.widths[of]), of) & (of != i)]
        if not len(could):
            return could
        where, owner, first, edge = self.index
        lists = [owner[first[t] : first[t + 1]] for t in where[edge[i] : edge[i + 1]].tolist()]
        overlap = np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n), np.int64)
        return could[self.similar(i, overlap[could], could)]

    def links(self) -> list[tuple[int, int]]:
        """Links that join all that are similar at this table, and no others."""
        groups, links = Groups(len(self.n)), []
        rest = np.arange(1, len(self.n))
        direct = rest[self.similar(0, np.zeros(len(rest), np.int64), rest)]
        for j in direct.tolist():
            groups.join(0, j)
            links.append((0, j))
        for i in np.setdiff1d(rest, direct).tolist() if len(rest) > 1 else ():
            for j in self.partners(i, rest).tolist():
                if groups.join(i, j):
                    links.append((i, j))
        return links

    def counts(self, copies: np.ndarray, earlier: list[np.ndarray], block: np.ndarray, within: bool) -> np.ndarray:
        """Of each set, the documents linked to it by the pairs that are counted here.

        A pair that meets at several centres is counted at the first alone; ``earlier`` are each set's centres before
        this one. Of a table of blocks, pairs of one block (and those with the centre) are counted where the block
        meets itself (``within``), others where their blocks meet.
        """
        out, after = np.zeros(len(self.n), np.int64), np.arange(len(self.n))
        flat, sizes = np.concatenate(earlier), [len(x) for x in earlier]
        centre, where = np.unique(flat, return_inverse=True)
        order = np.argsort(where, kind="stable")
        owner = np.repeat(after, sizes)[order]
        first, edge = np.searchsorted(where[order], np.arange(len(centre) + 1)), np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        for i in range(0 if within else 1, len(self.n)):
            free = after > i
            if not within:
                free &= block != block[i]
            for c in where[edge[i] : edge[i + 1]].tolist():
                free[owner[first[c] : first[c + 1]]] = False
            found = self.partners(i, np.flatnonzero(free))
            out[i] += copies[found].sum()
            out[found] += copies[i]
        return out


def table_links(centre: np.ndarray, sets: Iterator[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets (0 is the centre) that join all that are similar at this table, and no others."""
    return Table(centre, sets, percent).links()


def _table_links(attending: DataFrame, k: int, percent: int, counted: bool) -> DataFrame:
    """attending: (centre, b1, b2, guest, node, text), sorted so that a table's rows are together and its centre comes first.

    Rows are links (u, v) and, if counted (attending has copies, block, earlier as well), numbers of links (u, n).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(table, node, what the counts need, set) of each row."""
        for batch in pieces(batches):
            texts = raw_texts(batch.column(5))
            keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True)
            extra = zip(*(batch.column(i).to_pylist() for i in (6, 7, 8)), strict=True) if counted else [()] * len(texts)
            yield from zip(keys, batch.column(4).to_pylist(), extra, shingle_sets(texts, k), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in itertools.groupby(rows(batches), lambda row: row[0]):
            nodes, more = [], []

            def sets(at=at, group=group, nodes=nodes, more=more) -> Iterator[np.ndarray]:
                """One after the other, as the table keeps their differences alone; none if the centre isn't there."""
                for _, node, x, s in group:
                    # a repeated row comes right after its like
                    if digest(s) == node and (nodes[-1] != node if nodes else node == at[0]):
                        nodes.append(node)
                        more.append(x)
                        yield s

            guests = sets()
            if (centre := next(guests, None)) is None:
                continue
            here = Table(centre, guests, percent)
            if len(nodes) < 2:
                continue
            u, v, n = [], [], []
            for i, j in here.links():
                u.append(nodes[i])
                v.append(nodes[j])
                n.append(None)
            if counted:
                copies, block, earlier = zip(*more, strict=True)
                got = here.counts(np.array(copies, np.int64), [np.array(x, np.int64) for x in earlier], np.array(block), at[1] == at[2])
                for i in np.flatnonzero(got).tolist():
                    u.append(nodes[i])
                    v.append(None)
                    n.append(int(got[i]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "n"])

    return mapped(attending, run, "u binary, v binary, n bigint")


def links(docs: DataFrame, described: DataFrame, k: int, percent: int, table_rows: int = TABLE_ROWS, counted: bool = False) -> DataFrame:
    """(u, v) pairs of nodes that are similar, enough to reach from each node all that links of any kind reach.

    If counted, there are also rows (u, n) whose sum over u is the number of documents of other nodes similar to u.
    """
    reps = described.where("node is not null").groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("r"), F.count(F.lit(1)).alias("copies")).select("node", "r.r1", "r.r2", "copies")
    sketch = _sketch(described)
    prefixes = staged(_prefixes(docs, k, percent, sketch), "prefixes")
    own = prefixes.join(reps.drop("copies"), ["r1", "r2"]).select("node", "n", "need", F.explode("tokens").alias("token"))
    # Counts alone travel here; a token that only rows of one set hold finds no guest below. Written first, so that the
    # shuffle behind it is gone before the next one.
    shared = staged(own.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token"), "shared")
    live = staged(own.join(shared, "token"), "tokens")
    unstage(prefixes)
    unstage(shared)
    # Sizes fall into classes such that similar sets are in the same or in neighbouring ones; a window holds two classes.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-6))).cast("int")
    seats = live.withColumn("w", F.explode(F.array(size_class, size_class + 1)))
    tables = seats.groupBy("token", "w").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("seated"), F.max("node").alias("other")).where("centre != other")
    sits = seats.join(tables.select("token", "w", "centre", (F.col("seated") > 2).alias("many")), ["token", "w"])
    # Of tables for two, a pair needs as many as it must match; larger ones are always attended.
    asks = sits.where("node != centre").groupBy("centre", "node").agg(F.max("many").alias("many"), F.count_distinct("token").alias("matches"), F.max("need").alias("need"))
    needs = live.groupBy("node").agg(F.min("need").alias("least"))
    asks = asks.join(needs.select(F.col("node").alias("centre"), "least"), "centre").where(F.col("many") | (F.col("matches") >= F.least("need", "least"))).select("centre", "node")
    asks = staged(asks, "tables")
    held = asks.groupBy("centre").agg(F.count(F.lit(1)).alias("rows"))
    asks = asks.unionByName(held.select("centre", F.col("centre").alias("node")))
    blocks = F.ceil(F.col("rows") / table_rows).cast("int")
    blocks = F.when(blocks > 1, 2 * blocks).otherwise(1)
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    everywhere = F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.transform(F.sequence(i, blocks - 1), lambda j: F.struct(i.alias("b1"), j.alias("b2")))))
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, mine).alias("b1"), F.greatest(i, mine).alias("b2")))
    placed = asks.join(held, "centre").withColumn("p", F.explode(F.when(F.col("node") == F.col("centre"), everywhere).otherwise(places))).select("centre", "p.b1", "p.b2", "node", mine.alias("block"))
    text, more = docs.select("r1", "r2", "text"), []
    if counted:
        order = F.xxhash64("centre")
        reps = reps.join(asks.groupBy("node").agg(F.collect_set(order).alias("centres")), "node")
        more = ["copies", "block", F.filter("centres", lambda x: x < order).alias("earlier")]
    sent = placed.join(reps, "node").join(text, ["r1", "r2"]).select("centre", "b1", "b2", (F.col("node") != F.col("centre")).alias("guest"), "node", "text", *more)
    return _table_links(sent.repartition("centre", "b1", "b2").sortWithinPartitions("centre", "b1", "b2", "guest", "node"), k, percent, counted)


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, table_rows: int = TABLE_ROWS, n_links: bool = False) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links), one row for each row of docs.

    With n_links also that: how many other rows of docs are similar to the row, equal ones among them.
    """
    docs = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("second"), key, text).alias("r2"), F.col(text).alias("text"))
    described = staged(_described(docs, k), "sets")
    rows = described.where("part is null").select("id", "n", "node")
    linked = links(docs, described, k, percent, table_rows, n_links)
    if n_links:
        linked = staged(linked, "linked")
    roots = connected(linked.where("v is not null"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    more = []
    if n_links:
        named = named.join(linked.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others")), "node", "left")
        more = [F.when(F.col("node").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")]
    out = rows.join(named.drop("root", "least"), "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def lesser(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The keys of documents that are similar, directly or through others, to one with a smaller key."""
    return components(docs, key=key, text=text, k=k, percent=percent).where(F.col("component_id") < F.col(key)).select(key).distinct()


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs less all documents of a component but the one with the smallest key; null keys stay, and so do all rows of that key."""
    gone = lesser(docs, key=key, text=text, k=k, percent=percent).withColumnRenamed(key, "_gone")
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90, n_links=True)
