"""A reservoir that merges: each partition keeps rows under random keys and skips ahead, the smallest keys of all are the sample."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankeval.session import ship


class Reservoir:
    """Keys of the rows that enter a reservoir of k.

    Every row has a uniform key and the k smallest stay. Once k keys are held, a row enters with the chance that its key is
    below the largest held one, so the number of rows to skip is drawn at once and those rows are not looked at.
    """

    def __init__(self, k: int, rng: random.Random):
        self.k, self.rng, self.skip = k, rng, 0
        self.held: list[float] = []  # a heap of negated keys

    def push(self, n: int) -> tuple[list[int], list[float]]:
        """(places, keys) of those of the next n rows that enter."""
        places, keys, i = [], [], 0
        while i < n:
            if len(self.held) < self.k:
                key = self.rng.random()
                heapq.heappush(self.held, -key)
            else:
                if i + self.skip >= n:
                    self.skip -= n - i
                    break
                i += self.skip
                key = self.rng.random() * -self.held[0]
                heapq.heapreplace(self.held, -key)
            places.append(i)
            keys.append(key)
            i += 1
            if len(self.held) == self.k:
                self.skip = int(math.log(1 - self.rng.random()) / math.log1p(self.held[0]))
        return places, keys


def reservoir(rows: DataFrame, k: int, *, seed: int, group: str | None = None) -> DataFrame:
    """k rows of each group (or of all), each set of k as likely as any other; fewer where there are no more.

    A partition gives the rows that ever entered its reservoir, about k log(n / k) of n; the k smallest keys are taken over
    all of them, whatever their order. Its random numbers follow from the seed and its first row, not from its number.
    """
    if k < 1:
        return rows.limit(0)
    ship(rows.sparkSession)
    columns = rows.columns
    marked = rows.withColumn("_first", F.xxhash64(*columns))
    if group:
        marked = marked.sortWithinPartitions(group)
    at = columns.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, now, seen = None, None, False
        for batch in batches:
            for start, stop, name in _runs(batch, at):
                if not seen or name != now:
                    sampler, now, seen = Reservoir(k, random.Random(f"{seed}:{name}:{batch.column(len(columns))[start].as_py()}")), name, True
                places, keys = sampler.push(stop - start)
                if places:
                    taken = batch.slice(start, stop - start).take(pa.array(places))
                    yield pa.RecordBatch.from_arrays([*taken.columns[: len(columns)], pa.array(keys, pa.float64())], [*columns, "_key"])

    found = marked.mapInArrow(run, StructType([*rows.schema.fields, StructField("_key", DoubleType())]))
    if not group:
        return found.orderBy("_key").limit(k).select(*columns)
    w = Window.partitionBy(group).orderBy("_key")
    return found.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).select(*columns)


def _runs(batch: pa.RecordBatch, at: int | None) -> Iterator[tuple[int, int, object]]:
    """(start, stop, group) of the groups of a sorted batch; with at None the batch as one."""
    if at is None or not batch.num_rows:
        if batch.num_rows:
            yield 0, batch.num_rows, None
        return
    names, start = batch.column(at).to_pylist(), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield start, i, names[start]
            start = i
