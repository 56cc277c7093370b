"""The vector index on disk: rows by model, what it was made with, and what is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankeval.sources.store import Conflict, Log, delete


class IndexIncompatible(ValueError):
    """The index was made with another model, revision or size."""


class IndexMissing(LookupError):
    """Blobs have no vectors."""


@dataclass(frozen=True)
class Model:
    name: str
    revision: str
    dimensions: int
    query_prefix: str = ""

    @property
    def slug(self) -> str:
        return f"{self.name.replace('/', '__')}@{self.revision[:12]}"


VECTORS = "blob string, pos int, embedding array<float>"


def _opened(spark: SparkSession, root: str, model: Model) -> tuple[Log, list[dict]]:
    log = Log(spark, f"{root.rstrip('/')}/model={model.slug}")
    entries = log.entries()
    if entries:
        m = entries[0]
        if (m["name"], m["revision"], m["dimensions"]) != (model.name, model.revision, model.dimensions):
            raise IndexIncompatible(f"made with {m['name']}@{m['revision']} of {m['dimensions']}")
    return log, entries


def open_index(spark: SparkSession, root: str, model: Model) -> DataFrame | None:
    """(blob, pos, embedding), or None before the first write."""
    log, entries = _opened(spark, root, model)
    return log.table("vectors", entries)


def append(vectors: DataFrame, root: str, model: Model) -> int:
    """Add the vectors of blobs that are not there yet, all of a call or none; how many blobs these are.

    What is written is seen once its entry stands in the index's log, with the model beside it. Vectors of another length
    are refused. Of two writers the later one looks again at what is there, so no blob comes in twice.
    """
    size = F.when(F.size("embedding") == model.dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {model.dimensions} expected")))
    rows = vectors.select("blob", "pos", size.alias("embedding"))
    while True:
        log, entries = _opened(vectors.sparkSession, root, model)
        new = rows.join(log.table("blobs", entries), "blob", "left_anti") if entries else rows
        part = log.new_folder()
        written = log.write(new, part, "vectors")
        n = log.write(written.groupBy("blob").agg(F.count(F.lit(1)).alias("chunks")), part, "blobs").count()
        if entries and not n:
            delete(vectors.sparkSession, part)
            return 0
        try:
            log.commit(part, len(entries), name=model.name, revision=model.revision, dimensions=model.dimensions, blobs=n, bytes=written.count() * model.dimensions * 4)
            return n
        except Conflict:
            delete(vectors.sparkSession, part)


def has(blobs: DataFrame, root: str, model: Model) -> DataFrame:
    """blobs (blob, ...) with `indexed`, from the list of blobs alone."""
    log, entries = _opened(blobs.sparkSession, root, model)
    if not entries:
        return blobs.withColumn("indexed", F.lit(False))
    return blobs.join(log.table("blobs", entries).select("blob", F.lit(True).alias("_in")), "blob", "left").withColumn("indexed", F.coalesce("_in", F.lit(False))).drop("_in")


def size(spark: SparkSession, root: str, model: Model) -> tuple[int, int]:
    """(blobs, bytes of vectors) as the log has them."""
    _, entries = _opened(spark, root, model)
    return sum(e["blobs"] for e in entries), sum(e["bytes"] for e in entries)


def query_texts(queries: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """queries with what the model wants in front of a query; documents go to the encoder as they are."""
    return queries.withColumn(text, F.concat(F.lit(model.query_prefix), F.coalesce(F.col(text), F.lit(""))))


def require(tree: DataFrame, index: DataFrame) -> None:
    lost = [r[0] for r in tree.select("blob").distinct().join(index.select("blob").distinct(), "blob", "left_anti").limit(5).collect()]
    if lost:
        raise IndexMissing(f"no vectors for {lost}")
