"""An index that follows a stream of trees. An extension: batches of new files are met with the index as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankeval.operators.chunking import chunk_text, chunked
from rankeval.operators.dense import extend_index
from rankeval.sources.index import Model, append, open_index


def follow(files: DataFrame, root: str, model: Model, encode: Callable, checkpoint: str) -> StreamingQuery:
    """files: a stream of (blob, text). A batch that comes twice adds nothing: its blobs are there already."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        blobs = batch.dropDuplicates(["blob"])
        chunks = chunked(blobs, bodies=True).select("blob", "pos", chunk_text().alias("text"))
        new = extend_index(blobs, open_index(spark, root, model), chunks, encode)
        append(new, root, model)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
