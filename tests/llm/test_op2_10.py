import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankeval.llm import knn_quality, labelled, toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(0)
    first = np.array([0, 4, 4, 5, 11])
    emit, moves = np.exp(r.normal(size=11)), np.exp(r.normal(size=(2, 2)))
    got = toxicity.marginals(emit, first, moves)
    for a, b in itertools.pairwise(first):
        total, on = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=int(b - a)):
            p = np.prod([emit[a + i] for i, s in enumerate(path) if s]) * np.prod([moves[s, t] for s, t in itertools.pairwise(path)])
            total += p
            on += p * np.array(path)
        if b > a:
            assert np.allclose(got[a:b], on / total)
    inner = np.array([0, 1, 2])
    p = toxicity._pairs(emit, first, moves, inner)
    assert np.isclose(p.sum(), 3) and np.isclose(p[1].sum(), got[:3].sum()) and np.isclose(p[:, 1].sum(), got[1:4].sum())


def chat(r, toxic):
    words = ["".join(r.choice("aeiourst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 80))]
    if toxic:
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(["idiotic", "vile", "rotten"])
    return " ".join(words)


def test_toxic_spans_and_edges(spark):
    r = random.Random(1)
    rows = [(chat(r, i % 4 == 0).encode(), int(i % 4 == 0)) for i in range(600)]
    model = toxicity.fit(rows)
    fresh = [(chat(r, i % 2), i % 2) for i in range(200)]
    assert sum((s >= 0.7) == y for (_, s, _), (_, y) in zip(toxicity.scored([t.encode() for t, _ in fresh], model), fresh, strict=True)) >= 196
    docs = [(1, "é was a Rotten, vile thing. Rest", "x"), (2, None, "x"), (3, "", "x"), (4, "rest " * 30000, "x"), (5, "vile", "x"), (5, "vile", "x"), (None, "...", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {x.doc_id: x for x in toxicity.tag(df, model).collect()}
    assert len(got) == 6 and toxicity.tag(df, model).count() == 7
    assert "Rotten, vile" in [docs[0][1][s["from"] : s["to"]] for s in got[1].spans]
    assert not got[2].spans and got[2].score == got[3].score < 0.7 and got[4].n_words == 30000 and 0 <= got[4].score < 0.7
    assert {x.doc_id for x in toxicity.without_toxic(df, model).collect()} >= {2, 3, 4, None}
    assert toxicity.tag(df.limit(0), model).count() == 0
    assert all(s == 0 or s < 1e-9 for _, s, _ in toxicity.scored([b"vile"], toxicity.fit([])))


def test_learning_keeps_to_its_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i} {i * 7919}") for i in range(60)] + [(None, "null id"), (61, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (1, None), (None, 1), (61, 1), (99, 0)], "doc_id long, toxic int")
    got = labelled.training_texts(docs, labels, "toxic", 100)
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert {t for t, _ in got if t} <= {f"text number {i} {i * 7919}".encode() for i in free}
    assert len(labelled.training_texts(docs, labels, "toxic", 3)) <= 6
    flags = {r[0]: r[1] for r in docs.select("doc_id", labelled.held_out()).collect()}
    assert flags[None] is False and all(flags[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))


def test_copies_count_as_one_row_and_all_words_are_learnt(spark):
    r = random.Random(3)
    texts = [chat(r, i % 3 == 0).encode() for i in range(90)]
    copies = [texts[7], texts[7] + b" at the end", texts[7]]
    group = labelled.groups([*texts, *copies, b"", b"", b"two words"])
    assert group[7] == 7 and group[90:93].tolist() == [7, 7, 7] and group[93] == group[94] == 93 and group[95] == 95
    share = labelled.shares([*texts, *copies])
    assert np.isclose(share.sum(), 90) and np.isclose(share[[7, 90, 91, 92]], 0.25).all()
    # A word that stands in copies of one toxic document alone is no toxic word; one in many documents is, wherever these stand.
    odd = "zanquilo " + chat(r, False)
    rows = [(chat(r, i % 4 == 0).encode(), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.fit([*rows, *[(odd.encode(), 1)] * 40])
    marks = [list(x[2]) for x in toxicity.scored([b"zanquilo", b"idiotic", b"rotten"], model, spans=True)]
    assert not marks[0] and marks[1] and marks[2]


def test_sample_keeps_near_copies(spark):
    docs = spark.createDataFrame([(i, "one text for all of them") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    free = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert len(labelled.training_texts(docs, labels, "toxic", 100)) == free


def accuracy(df, labels, column):
    x = df.join(labels, "doc_id").where("held_out")
    return x.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality, toxic = knn_quality.op10(spark, SF), toxicity.op2(spark, SF)
    assert accuracy(quality, labels, "quality") > 0.95 and accuracy(toxic, labels, "toxic") > 0.9
    for df in (quality, toxic):
        assert df.count() == 1000 and df.where("score between 0 and 1").count() == 1000


def test_held_out_recall_of_toxic_documents(spark):
    """Of held-out rows labelled toxic most are found, none of the others is: some labels have no toxic word to go by."""
    sf = "/root/testdata/sf0.1"
    x = toxicity.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, other = x[x.toxic == 1], x[x.toxic == 0]
    assert len(toxic) > 100 and toxic.predicted.mean() >= 0.9 and other.predicted.mean() < 0.01
    below = np.searchsorted(np.sort(other.score), toxic.score.to_numpy(), "left") + np.searchsorted(np.sort(other.score), toxic.score.to_numpy(), "right")
    assert below.mean() / 2 / len(other) > 0.95  # the area under the curve


def test_neighbours_against_brute_force_and_edges(spark):
    r = random.Random(2)
    rows = [(("GOOD words here " if y else "bad!! bad!! ").encode() * r.randrange(1, 5) + str(i).encode(), y) for i in range(80) for y in [i % 3 == 0]]
    rows = [(t, int(y)) for t, y in rows]
    model = knn_quality.fit(rows)
    texts = [b"GOOD words", b"bad!! 7", b"other text altogether", *(t for t, _ in rows[:40]), b"GOOD bad!! words " * 40_000]
    v = knn_quality.latent(knn_quality.terms(texts), model.centre, model.directions)
    for x, s in zip(v, knn_quality.scored(texts, model), strict=True):
        near = model.vectors @ x
        best = sorted(range(len(near)), key=lambda i: (-near[i], i))[: knn_quality.NEIGHBOURS]
        weight = np.maximum(near[best], 1e-6) * model.votes[best]
        assert abs((weight * model.labels[best]).sum() / weight.sum() - s) < 1e-6
    docs = [(1, None, "x"), (2, "", "x"), (3, "GOOD words here", "x"), (3, "GOOD words here", "x"), (None, "bad!! " * 30000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = [(x.doc_id, x.score) for x in knn_quality.score(df, model).collect()]
    by = dict(got)
    assert len(got) == 5 and abs(by[1] - 0.5) < 1e-9 and by[1] == by[2] and by[3] > 0.5 > by[None]
    assert knn_quality.score(df.limit(0), model).count() == 0 and (knn_quality.scored([b"x"], knn_quality.fit([])) == 0.5).all()
