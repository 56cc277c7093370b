"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a row of weighted terms: pairs of neighbouring bytes (hashed), letter case and sign shares, and how much of it
repeats itself. The latent directions are the leading ones of the labelled texts' term matrix. The labelled vectors are
broadcast (at most 2 * per_class of them, of DIMS numbers), every document is compared with all of them by exact
products of blocks, and its nearest ones vote with their similarity, each class weighing the same in the whole sample.

Defined results: null and empty texts are the text without terms, whose vector is zero: all labelled texts are as near
and the sample's balance decides (0.5); ties among neighbours are broken by their order in the sample; rows are judged
each by itself, so repeated rows and empty tables need nothing special; without labels of both classes the score is the
only class seen, or 0.5; a very long text is one row of terms, read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import NOT_SPACE, Words, chunks, mapped, pieces, raw_texts, table
from rankeval.llm.labelled import distinct, held_out, training_texts

PER_CLASS = 2000
THRESHOLD = 0.5
DIMS = 48
NEIGHBOURS = 15
PAIRS = 1024
#: Shares that are terms of their own, each in so many steps.
MEASURES, STEPS = 5, 12

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = True
_letters[128:] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_signs = np.zeros(256, bool)
_signs[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def terms(texts: list[bytes]) -> np.ndarray:
    """A row of term weights for each text."""
    out = []
    for a, b in chunks(texts):
        n = b - a
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        sizes = np.array([len(t) for t in texts[a:b]])
        doc = np.repeat(np.arange(n), sizes + 1)[: len(buf)]
        pair = buf[:-1].astype(np.uint32) << 8 | buf[1:] if len(buf) > 1 else np.zeros(0, np.uint32)
        own = doc[:-1] == doc[1:] if len(buf) > 1 else np.zeros(0, bool)
        slot = (pair * np.uint32(0x9E3779B1)) >> np.uint32(22)
        counts = np.bincount(doc[:-1][own].astype(np.int64) * PAIRS + slot[own], minlength=n * PAIRS).reshape(n, PAIRS) if len(buf) > 1 else np.zeros((n, PAIRS))
        shares = counts / np.maximum(1, counts.sum(1, keepdims=True))
        w = Words(texts[a:b], NOT_SPACE)
        of = lambda flags, whole: np.bincount(doc[flags[buf]], minlength=n) / np.maximum(1, whole)
        letters = np.bincount(doc[_letters[buf]], minlength=n)
        words = np.diff(w.first)
        place, h = w.windows(4)
        keyed = np.unique(np.stack([w.doc[place].astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        windows = np.bincount(w.doc[place], minlength=n)
        fresh = np.bincount(keyed[:, 0].astype(np.int64), minlength=n)
        measures = [
            np.bincount(doc[_upper[buf]], minlength=n) / np.maximum(1, letters),
            of(_signs, sizes),
            1 - fresh / np.maximum(1, windows),
            np.minimum(1, np.log2(1 + words) / 16),
            np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) / np.maximum(1, words),
        ]
        extra = np.zeros((n, len(measures) * STEPS))
        for i, m in enumerate(measures):
            extra[np.arange(n), i * STEPS + np.minimum(STEPS - 1, (np.sqrt(m) * STEPS).astype(int))] = 0.25 * (sizes > 0)
        out.append(np.concatenate([np.sqrt(shares), extra], 1))
    return np.concatenate(out) if out else np.zeros((0, PAIRS + MEASURES * STEPS))


@dataclass
class Model:
    """Centre and directions of the latent space, and the labelled vectors with their votes."""

    centre: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray


def latent(rows: np.ndarray, centre: np.ndarray, directions: np.ndarray) -> np.ndarray:
    v = (rows - centre * (rows.any(1)[:, None])) @ directions
    return (v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))).astype(np.float32)


def fit(rows: list[tuple[bytes, int]], dims: int = DIMS) -> Model:
    x, y = terms([t for t, _ in rows]), np.array([v for _, v in rows], float)
    if not len(y):
        return Model(np.zeros(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros((0, 1), np.float32), y, y)
    centre = x.mean(0)
    values, axes = np.linalg.eigh((x - centre).T @ (x - centre))
    directions = axes[:, np.argsort(-values)[:dims]]
    share = np.array([max(1e-9, (y == 0).mean()), max(1e-9, (y == 1).mean())])
    return Model(centre, directions, latent(x, centre, directions), y, 1 / share[y.astype(int)])


def scored(texts: list[bytes], model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(texts), 0.5)
    out = []
    for a, b in chunks(texts):
        part = latent(terms(texts[a:b]), model.centre, model.directions)
        for i in range(0, len(part), 256):
            near = part[i : i + 256] @ model.vectors.T
            k = min(neighbours, near.shape[1])
            # the k nearest; of equally near ones the first
            nearest = np.argpartition(np.arange(near.shape[1]) * 1e-12 - near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, nearest, 1), 1e-6).astype(float) * model.votes[nearest]
            vote = (weight * model.labels[nearest]).sum(1) / weight.sum(1)
            blank = ~part[i : i + 256].any(1)
            out.append(np.where(blank, (model.votes * model.labels).sum() / model.votes.sum(), vote))
    return np.concatenate(out) if out else np.zeros(0)


def model_of(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Model:
    return fit(distinct(training_texts(docs, labels, label, per_class, key=key, text=text)))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """key and score (0 to 1, higher: the label 1 is likelier)."""
    docs = docs.select(F.col(key).alias("key"), F.col(text))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(raw_texts(batch.column(1)), sent.value, neighbours), pa.float64())], ["key", "score"])

    return mapped(docs, run, f"key {docs.schema[0].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
