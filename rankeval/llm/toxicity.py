"""Toxic spans by a linear-chain conditional random field over words.

fit() labels the words of labelled documents: a word is toxic where its document is and where it, or its beginning,
belongs to toxic documents far more than to others. A chain of two states is trained on these by gradient ascent on the
conditional likelihood. At scoring, forward-backward gives each word's marginal; runs of words over 0.5 are the offending
spans; the expected number of toxic words in the spans, and its share of all words, give the document's score by a
logistic curve. All rows of the sample take part, near copies together as one row.

Defined results: null, empty and wordless texts have no spans and the score of no toxic words; each row is judged by
itself, so ties, repeated rows and empty tables need nothing special; without labels of both classes nothing is toxic
(score 0); a very long text is one chain, scored whole in memory in proportion to its length; further columns are ignored
by tag() and kept by without_toxic(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import ALNUM, CHUNK_BYTES, Words, chunks, mapped, mixed, pieces, prefix_hash, range_hash, raw_texts, table
from rankeval.llm.labelled import held_out, shares, training_texts

#: Bound on the labelled rows of each class that the model is fitted on.
PER_CLASS = 3000
THRESHOLD = 0.7
BITS = 19
#: Features of a word: itself, and its first bytes at each of these lengths.
HEADS = (4, 5)
SEGMENT = 64
SPREAD = 8 * CHUNK_BYTES


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: exp of the transition scores, [from, to].
    moves: np.ndarray
    #: Of the logistic curve over document_features().
    curve: np.ndarray


def features(w: Words) -> np.ndarray:
    """(words, 1 + len(HEADS)) places in the weights."""
    return np.stack([(x >> np.uint64(64 - BITS)).astype(np.int64) for x in _feature_hashes(w)], 1)


def _feature_hashes(w: Words) -> list[np.ndarray]:
    if not len(w.hash):
        return [w.hash] * (1 + len(HEADS))
    sums = prefix_hash(w.buf)
    out = [w.hash, *(range_hash(sums, w.starts, np.minimum(w.starts + n, w.ends)) for n in HEADS)]
    return [mixed(x + np.uint64(i)) for i, x in enumerate(out)]


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Each word's probability of state 1. emit: odds of the words' emissions; first: where each chain begins, and the end.

    All chains advance together, longest first, so that those still running are a prefix.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than t
    m00, m01, m10, m11 = moves.ravel().tolist()
    ahead = np.ones(len(emit))  # state 1 over state 0, words up to here
    ratio = None
    for t in range(steps):
        at = begin[: running[t]] + t
        ratio = emit[at] if t == 0 else emit[at] * (m01 + m11 * (r := ratio[: running[t]])) / (m00 + m10 * r)
        ratio = np.clip(ratio, 1e-12, 1e12)
        ahead[at] = ratio
    back = np.ones(len(emit))  # state 1 over state 0, words after here
    held = np.ones(len(sizes))
    for t in range(steps - 2, -1, -1):
        n = running[t + 1]
        r = held[:n] * emit[begin[:n] + t + 1]
        held[:n] = (m10 + m11 * r) / (m00 + m01 * r)
        back[begin[:n] + t] = held[:n]
    both = ahead * back
    return both / (1 + both)


@dataclass
class _Learnt:
    """The words of the rows that the chain is fitted on: feature hashes, document of each word, first words of documents."""

    hashes: list[np.ndarray]
    doc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> _Learnt:
        """Chunk by chunk, as hashing takes many times a text's size."""
        hashes, doc, first, n = [[] for _ in range(1 + len(HEADS))], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for a, b in chunks(texts):
            w = Words(texts[a:b], ALNUM)
            for held, h in zip(hashes, _feature_hashes(w), strict=True):
                held.append(h)
            doc.append((w.doc + a).astype(np.int32))
            first.append(w.first[1:] + n)
            n += len(w.hash)
        return cls([np.concatenate(h) for h in hashes], np.concatenate(doc), np.concatenate(first))

    def places(self) -> np.ndarray:
        return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in self.hashes], 1)

    def labels(self, toxic: np.ndarray, share: np.ndarray, odds: float, support: float) -> np.ndarray:
        """1 for words of toxic documents that are typical of those: odds times as frequent there, in the share support of them and in three.

        share: what each document counts.
        """
        out = np.zeros(len(self.doc), bool)
        n1, n0 = share[toxic].sum(), share[~toxic].sum()
        for column in self.hashes:
            where, token = pd.factorize(column)
            where = where.astype(np.int32)
            pair = self.doc.astype(np.int64) * len(token) + where
            pair.sort()
            pair = pair[np.diff(pair, prepend=-1) > 0]
            doc, which = (pair // max(1, len(token))).astype(np.int32), (pair % max(1, len(token))).astype(np.int32)
            del pair
            in1 = np.bincount(which, np.where(toxic, share, 0)[doc], len(token))
            in0 = np.bincount(which, np.where(toxic, 0, share)[doc], len(token))
            typical = (in1 + 0.5) / (n1 + 1) > odds * (in0 + 0.5) / (n0 + 1)
            out |= (typical & (in1 > max(3, support * n1) - 1e-6))[where]
        return out & toxic[self.doc]


def fit(rows: list[tuple[bytes, int]], *, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6, odds: float = 8, support: float = 0.01) -> Model:
    """The chain from all words of all rows, then the document curve from all rows; odds and support say which words are labelled toxic.

    Near copies share the weight of one row.
    """
    none = Model(np.zeros(1 << BITS, np.float32), -20.0, np.ones((2, 2)), np.array([0.0, 0.0, -50.0]))
    if len({y for _, y in rows}) < 2:
        return none
    texts, toxic = [t for t, _ in rows], np.array([y == 1 for _, y in rows])
    w, share = _Learnt.of(texts), shares(texts)
    labels = w.labels(toxic, share, odds, support)
    if not labels.any():
        return none
    # Segments of at most SEGMENT words; a segment is a chain of its own here.
    first = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])
    ends = np.append(first[1:], len(w.doc))
    weight = share[w.doc[first]]
    places = w.places()
    w.hashes.clear()
    weights, bias, moves = np.zeros(1 << BITS), -4.0, np.zeros((2, 2))
    moves[0, 0], grown, grown_small = 0.0, np.full(1 << BITS, 1e-8), np.full(5, 1e-8)
    random = np.random.default_rng(0)
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(first)), min(len(first), max(20, len(first) // 800))):
            sizes = ends[batch] - first[batch]
            edge = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(first[batch] - edge[:-1], sizes) + np.arange(edge[-1])
            f, y = places[at], labels[at].astype(float)
            e = np.exp(np.clip(weights[f].sum(1) + bias, -25, 25))
            m = np.exp(moves)
            p = marginals(e, edge, m)
            each, total = np.repeat(weight[batch], sizes), weight[batch].sum()
            miss = (y - p) * each
            g = np.bincount(f.ravel(), np.repeat(miss, f.shape[1]), 1 << BITS) / total - l2 * weights
            # Expected pairs of states from the marginals of two words in a row, under the chain's local coupling.
            inner = np.ones(len(at), bool)
            inner[edge[1:] - 1] = False
            i = np.flatnonzero(inner)
            now, then = np.stack([1 - y[i], y[i]]), np.stack([1 - y[i + 1], y[i + 1]])
            gm = ((now * each[i]) @ then.T - _pairs(e, edge, m, i, each[i])).ravel()[1:] / total
            grown += g * g
            weights += rate * g / np.sqrt(grown)
            small = np.array([miss.sum() / total, *gm, 0.0])
            grown_small += small * small
            step = 0.1 * small / np.sqrt(grown_small)
            bias += step[0]
            moves.ravel()[1:] += step[1:4]
    model = Model(weights.astype(np.float32), float(bias), np.exp(np.clip(moves, -8, 8)), np.zeros(3))
    del w, places, labels  # the curve's rows need their own memory
    x = []
    for a, b in chunks(texts):
        part = Words(texts[a:b], ALNUM)
        x.append(document_features(part, _marginals_of(part, model)))
    model.curve = _logistic(np.concatenate(x), toxic.astype(float), share)
    return model


def _pairs(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, inner: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Expected numbers of [state, next state] over neighbouring words, each counting its weight."""
    p = marginals(emit, first, moves)
    odds = p / np.maximum(1 - p, 1e-12)
    # back = marginal odds / forward odds; the pair (i, i + 1) is forward(i) * move * emission(i + 1) * back(i + 1).
    ahead = _forward(emit, first, moves)
    back = odds / np.maximum(ahead, 1e-12)
    a, r = ahead[inner], emit[inner + 1] * back[inner + 1]
    cells = np.stack([np.full(len(a), moves[0, 0]), moves[0, 1] * r, moves[1, 0] * a, moves[1, 1] * a * r])
    return (cells * (weight / cells.sum(0))).sum(1).reshape(2, 2)


def _forward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    sizes = np.diff(first)
    out = np.ones(len(emit))
    ratio = np.ones(len(sizes))
    for t in range(int(sizes.max()) if len(sizes) else 0):
        on = np.flatnonzero(sizes > t)
        at = first[on] + t
        r = ratio[on]
        ratio[on] = np.clip(emit[at] if t == 0 else emit[at] * (moves[0, 1] + moves[1, 1] * r) / (moves[0, 0] + moves[1, 0] * r), 1e-12, 1e12)
        out[at] = ratio[on]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps, with a little shrinkage so that a clean split stays finite. weight: what each row counts."""
    v = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.003 * np.eye(len(v))
        v += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.003 * v)
    return v


def _marginals_of(w: Words, model: Model) -> np.ndarray:
    return marginals(np.exp(np.clip(model.weights[features(w)].sum(1) + model.bias, -25, 25).astype(float)), w.first, model.moves)


def document_features(w: Words, p: np.ndarray) -> np.ndarray:
    """Of each text: the logs of the expected toxic words among those of its spans (marginals over a half) and of their share; 1."""
    sure = np.bincount(w.doc, np.where(p > 0.5, p, 0.0), len(w.at) - 1)
    n = np.diff(w.first)
    return np.stack([np.log(sure + 0.1), np.log(sure / np.maximum(n, 1) + 1e-3), np.ones(len(n))], 1)


def scored(texts: list[bytes], model: Model, spans: bool = False) -> Iterator[tuple[int, float, list]]:
    """(words, score, spans as (first character, end, mean marginal)) of each text."""
    for first, last in chunks(texts, SPREAD):
        # Words are hashed in smaller parts; the chains of all parts then advance together.
        parts, emit, edge = [], [np.zeros(0)], [np.zeros(1, np.int64)]
        for a, b in chunks(texts[first:last]):
            w = Words(texts[first + a : first + b], ALNUM)
            emit.append(np.exp(np.clip(model.weights[features(w)].sum(1) + model.bias, -25, 25).astype(float)))
            edge.append(w.first[1:] + edge[-1][-1])
            w.hash = None
            parts.append(w)
        p, at = marginals(np.concatenate(emit), np.concatenate(edge), model.moves), 0
        for w in parts:
            yield from _judged(w, p[at : at + len(w.doc)], model, spans)
            at += len(w.doc)


def _judged(w: Words, p: np.ndarray, model: Model, spans: bool) -> Iterator[tuple[int, float, list]]:
    score = 1 / (1 + np.exp(-np.clip(document_features(w, p) @ model.curve, -50, 50)))
    found: dict[int, list] = {}
    if spans and (p > 0.5).any():
        chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        over, same = p > 0.5, w.doc[1:] == w.doc[:-1]
        linked = over[1:] & over[:-1] & same
        begins = np.flatnonzero(over & ~np.concatenate([[False], linked]))
        stops = np.flatnonzero(over & ~np.concatenate([linked, [False]]))
        for i, j in zip(begins.tolist(), stops.tolist(), strict=True):
            d = int(w.doc[i])
            at = chars[w.at[d]]
            found.setdefault(d, []).append((int(chars[w.starts[i]] - at), int(chars[w.ends[j]] - at), float(p[i : j + 1].mean())))
    for i in range(len(w.at) - 1):
        yield int(w.first[i + 1] - w.first[i]), float(score[i]), found.get(i, [])


def model_of(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Model:
    return fit(training_texts(docs, labels, label, per_class, key=key, text=text))


def tag(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, score, spans (characters from, to, and mean marginal)."""
    docs = docs.select(F.col(key).alias("key"), F.col(text))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = list(scored(raw_texts(batch.column(1)), sent.value, spans=True))
            spans = pa.array([[{"from": s, "to": e, "score": x} for s, e, x in r[2]] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), spans], ["key", "n_words", "score", "spans"])

    return mapped(docs, run, f"key {docs.schema[0].dataType.simpleString()}, n_words bigint, score double, spans array<struct<`from`: int, `to`: int, score: double>>").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs less those that score threshold or more."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([s < threshold for _, s, _ in scored(raw_texts(batch.column(at)), sent.value)], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tag(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
