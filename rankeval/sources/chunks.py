"""Chunks of sources kept by content: a blob is parsed and tokenized once, in however many files and commits it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankeval.functions.text import tokenize
from rankeval.operators import chunking
from rankeval.sources.store import Log


class Chunks:
    """(blob, pos, name, kind, signature, docstring, content, line, tokens) of all blobs that were ever asked for."""

    def __init__(self, spark: SparkSession, root: str, *, bodies: bool):
        self.log, self.bodies = Log(spark, f"{root.rstrip('/')}/{'bodies' if bodies else 'heads'}"), bodies

    def rows(self) -> DataFrame | None:
        return self.log.table("chunks")

    def extend(self, wanted: DataFrame, blobs: DataFrame) -> int:
        """Parse the blobs (blob, text) that wanted (blob) names and that are not here yet; how many these are."""
        entries = self.log.entries()
        new = wanted.select("blob").distinct()
        if entries:
            new = new.join(self.log.table("chunks", entries).where("pos = 0").select("blob"), "blob", "left_anti")
            if new.isEmpty():
                return 0
        texts = blobs.select("blob", "text").join(new, "blob", "left_semi").dropDuplicates(["blob"])
        part = self.log.new_folder()
        rows = chunking.chunked(texts, bodies=self.bodies).withColumn("tokens", tokenize(chunking.chunk_text()))
        n = self.log.write(rows, part, "chunks").where("pos = 0").count()
        self.log.commit(part, len(entries), blobs=n)
        return n
