"""A stored index of text pieces for literal search: which texts may hold a pattern, told without reading them.

Of every WINDOW neighbouring pieces of PIECE bytes the one with the least hash is an entry of its text. A pattern that has a
whole window inside therefore shares that entry with every text that holds it. Each part of the log keeps
  texts     (key, n)         what it covers
  entries   (key, grams)     a text's distinct entries, at most PART a row, as the tasks that read the texts write them
Nothing is sorted or shuffled by entry: a search sends out the entries of its patterns, and what leaves a task are their
counts and then the texts that hold them. Entries that stand in more than one of SHARE texts tell little and are not
looked for, so none is hot. search() meets the rarest entries of a pattern, takes the texts that hold all of them, and
looks there with contains(); only patterns without any such entry (short ones, and those of frequent pieces) need every text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankeval.session import ship
from rankeval.sources.store import Conflict, Log, staged

PIECE, WINDOW = 5, 4
SHARE, LEAST_CAP = 20, 64
#: Entries of a stored row, so that rows that travel together are bounded whatever the texts' lengths; rows that a task looks at together.
PART, ROWS = 1000, 1000
#: Entries of a pattern that are met, and characters of patterns that go through all texts together.
RAREST, SLICE_CHARS = 3, 100_000
#: Numbers or keys that may be broadcast.
BROADCAST = 2_000_000
#: Bytes that are hashed at a time.
BLOCK = 1 << 20


def entries_of(text: bytes) -> np.ndarray:
    """The distinct entries of a text, as signed 64-bit hashes."""
    out = []
    for a in range(0, max(0, len(text) - PIECE - WINDOW + 2), BLOCK):
        b = np.frombuffer(text[a : a + BLOCK + PIECE + WINDOW - 2], np.uint8).astype(np.uint64)
        n = len(b) - PIECE + 1
        h = np.zeros(n, np.uint64)
        for j in range(PIECE):
            h = h << np.uint64(8) | b[j : n + j]
        h *= np.uint64(0x9E3779B97F4A7C15)  # a bijection of the piece, and then one that mixes its bits
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _entries(rows: DataFrame) -> DataFrame:
    """(key, text) to (key, grams), the entries of a text in rows of at most PART."""
    kind, most = rows.schema[0].dataType.simpleString(), PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).cast(pa.binary())
            at, held = [], []
            for i in range(batch.num_rows):
                own = entries_of(texts[i].as_py() or b"")
                held += [own[j : j + most] for j in range(0, len(own), most)]
                at += [i] * (len(held) - len(at))
                if len(held) >= ROWS or held and i == batch.num_rows - 1:
                    edge = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(held)))], ["key", "grams"])
                    at, held = [], []

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"key {kind}, grams array<bigint>")


def _met(batches: Iterator[pa.RecordBatch], grams: np.ndarray) -> Iterator[tuple]:
    """(keys, the row of each entry met, its place in grams) of some rows (key, grams) after others."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            values = batch.column(1).flatten().to_numpy()
            at = np.minimum(np.searchsorted(grams, values), len(grams) - 1)
            met = np.flatnonzero(grams[at] == values)
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            yield batch.column(0), row[met], at[met]


def _counted(held: DataFrame, grams: np.ndarray) -> DataFrame:
    """(gram, df): in how many rows' texts each of these entries stands; grams are sorted. A task sends a row for each at most."""
    sent = held.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for _, _, at in _met(batches, sent.value):
            np.add.at(n, at, 1)
        some = np.flatnonzero(n)
        yield from pa.table([pa.array(sent.value[some]), pa.array(n[some])], ["gram", "df"]).to_batches(10_000)

    return held.mapInArrow(run, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))


def _found(held: DataFrame, grams: np.ndarray) -> DataFrame:
    """(key, gram) of the rows (key, grams) for each of these entries, which are sorted."""
    sent, kind = held.sparkSession.sparkContext.broadcast(grams), held.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, at in _met(batches, sent.value):
            if len(row):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(sent.value[at])], ["key", "gram"])

    return held.mapInArrow(run, f"key {kind}, gram bigint")


def _parts(grams: DataFrame) -> Iterator[np.ndarray]:
    """The distinct entries (gram), sorted, in arrays of at most BROADCAST."""
    rows = (r[0] for r in grams.distinct().toLocalIterator())
    while len(part := np.fromiter(itertools.islice(rows, BROADCAST), np.int64)):
        yield np.sort(part)


class Grams:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    def extend(self, texts: DataFrame) -> int:
        """Add the texts (key, text) whose keys are not here; how many keys these are. Null keys and texts are left out."""
        parts = self.log.entries()
        new = texts.where("key is not null and text is not null")
        if parts:
            new = new.join(self.log.table("texts", parts).select("key"), "key", "left_anti")
            if new.isEmpty():
                return 0
        part = self.log.new_folder()
        n = self.log.write(new.groupBy("key").agg(F.count(F.lit(1)).alias("n")), part, "texts").count()
        self.log.write(_entries(new.select("key", "text")), part, "entries")
        cap = max(LEAST_CAP, n // SHARE)
        self.log.commit(part, len(parts), texts=n, cap=cap)
        return n

    def candidates(self, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, pattern) of the texts that may hold patterns; and (part, pattern) of those that no entry tells about.

        patterns: (pattern), distinct and not null.
        """
        pairs, blind = [], []
        own = _entries(patterns.select(F.col("pattern").alias("key"), F.col("pattern").alias("text")))
        own = staged(own.select(F.col("key").alias("pattern"), F.explode("grams").alias("gram")), "asked")
        for e in self.log.entries():
            held = self.log.table("entries", [e])
            counts = _union([_counted(held, grams) for grams in _parts(own.select("gram"))], self.spark.createDataFrame([], "gram bigint, df bigint"))
            told = own.join(staged(counts, "counts"), "gram", "left")
            place = F.row_number().over(Window.partitionBy("pattern").orderBy("df", "gram"))
            nowhere = told.where("df is null").select("pattern").distinct()
            rare = told.where(F.col("df") <= e["cap"]).join(nowhere, "pattern", "left_anti").withColumn("place", place).where(F.col("place") <= RAREST)
            rare = staged(rare.select("pattern", "gram", F.count(F.lit(1)).over(Window.partitionBy("pattern")).alias("need")), "rare")
            found = _union([_found(held, grams) for grams in _parts(rare.select("gram"))], held.select("key", F.lit(0).cast("long").alias("gram")).limit(0))
            met = found.join(rare, "gram").groupBy("key", "pattern").agg(F.count_distinct("gram").alias("n"), F.max("need").alias("need"))
            pairs.append(met.where("n = need").select("key", "pattern"))
            left = patterns.join(nowhere, "pattern", "left_anti").join(rare.select("pattern").distinct(), "pattern", "left_anti")
            blind.append(left.select(F.lit(e["number"]).alias("part"), "pattern"))
        return _union(pairs), _union(blind)

    def search(self, texts: DataFrame, patterns: DataFrame) -> DataFrame:
        """(key, pattern) of every row of texts (key, text) and every pattern that its text holds.

        The index must cover texts. An empty pattern is in every text; null patterns are nowhere; repeated rows give
        repeated hits; rows without a key or a text are left out.
        """
        asked = staged(patterns.select("pattern").where("pattern is not null").distinct(), "patterns")
        rows = texts.select("key", "text").where("key is not null and text is not null")
        if not self.log.entries():
            return rows.select("key", F.col("text").alias("pattern")).limit(0)
        pairs, blind = self.candidates(asked)
        pairs = staged(pairs, "pairs")
        keys = pairs.select("key").distinct()
        # Texts that hold nothing stay where they are.
        near = rows.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= BROADCAST else rows
        out = near.join(pairs, "key").where(F.col("text").contains(F.col("pattern"))).select("key", "pattern")
        blind = staged(blind, "blind")
        whole = [e["number"] for e in self.log.entries()]
        for held, parts in _slices(blind):
            scanned = rows
            if parts != whole:
                covered = self.log.table("texts", [e for e in self.log.entries() if e["number"] in parts]).select("key")
                scanned = rows.join(covered, "key", "left_semi")
            found = F.filter(F.array(*map(F.lit, held)), lambda p: F.col("text").contains(p))
            out = out.unionByName(scanned.select("key", F.explode(found).alias("pattern")))
        return out


def _union(frames: list[DataFrame], none: DataFrame | None = None) -> DataFrame:
    out = frames[0] if frames else none
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _slices(blind: DataFrame) -> Iterator[tuple[list[str], list[int]]]:
    """Patterns in lists of bounded length, with the parts in which they must be looked for."""
    by_parts = blind.groupBy("pattern").agg(F.sort_array(F.collect_set("part")).alias("parts")).orderBy("parts", "pattern")
    held, size, now = [], 0, None
    for pattern, parts in by_parts.toLocalIterator():
        if held and (parts != now or size + len(pattern) > SLICE_CHARS):
            yield held, now
            held, size = [], 0
        held.append(pattern)
        size, now = size + len(pattern) + 1, parts
    if held:
        yield held, now


def ready(spark: SparkSession, root: str, texts: DataFrame) -> Grams:
    """The index at root with all of texts (key, text) in it, whoever adds them."""
    index = Grams(spark, root)
    while True:
        try:
            index.extend(texts)
            return index
        except Conflict:  # another writer was first: see what is still missing
            continue
