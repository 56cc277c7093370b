import hashlib
import random

import numpy as np
import pytest

from rankeval.llm import suffix_dedup


def brute(docs, length):
    places = {}
    texts = [(t or "").encode() for _, t in docs]
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s : s + length], []).append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in places.values():
        if len(at) > 1:
            for i, s in at:
                gone[i][s : s + length] = True
    out = []
    for (d, _), t, g in zip(docs, texts, gone, strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        spans = sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1]))
        out.append((d, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé中") for _ in range(r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.randrange(5, 60))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(1, 30))))
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[1][1][10:]), (102, "ab" * 300), (103, "x" * 500), (104, None), (105, ""), (105, ""), (106, "short"), (7, docs[7][1]), (None, docs[9][1])]
    return docs


@pytest.mark.parametrize("seed,block,hot", [(1, 6 << 20, 10**6), (2, 1, 10**6), (3, 6 << 20, 1)])
def test_against_brute_force(spark, seed, block, hot):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_bytes string")
    got = sorted((tuple(r) for r in suffix_dedup.digests(df, length=100, gram=30, block_bytes=block, hot_places=hot).collect()), key=str)
    assert got == brute(docs, 100)


def test_texts_and_empty_table(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(700))
    df = spark.createDataFrame([(1, "A" + long + "B", "k"), (2, "C" + long, "k"), (3, None, "k")], "doc_id long, text string, h string")
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    assert kept == {1: "AB", 2: "C", 3: None}
    assert suffix_dedup.digests(df.limit(0)).count() == 0


def test_columns_of_any_name_and_a_very_long_text(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(450))
    huge = "".join(r.choice("ijklmnop ") for _ in range(1_500_000))
    rows = [(1, huge + passage, "a", "b", "c", 1), (2, f"x{passage}y", "a", "b", "c", 2), (3, huge[5000:5400], "a", "b", "c", 3), (4, huge[7000:7399], "a", "b", "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _r1 string, _starts string, r2 string, row int")
    out = suffix_dedup.without_repeats(df).orderBy("doc_id").collect()
    assert [x.text for x in out] == [huge[:5000] + huge[5400:], "xy", "", rows[3][1]]
    assert [tuple(x)[2:] for x in out] == [x[2:] for x in rows]


def test_difference_cover():
    for v in (32, 64, 100):
        d = set(suffix_dedup.difference_cover(v).tolist())
        assert all(any((i + s) % v in d and (j + s) % v in d for s in range(v)) for i in range(v) for j in range(v))


def test_planted_passages_of_short_and_long_words(spark, tmp_path):
    """A passage of 400 bytes or more is caught wherever it stands; a shorter one, however many its words, and clean documents stay."""
    r = random.Random(9)
    words = lambda n, size: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(*size))) for _ in range(n))
    passages = [words(n, size) for n in (51, 60, 80, 100, 120) for size in ((2, 4), (3, 7), (8, 12))]
    docs = [(3 * i + j, f"{words(r.randrange(0, 80), (2, 9))}\n{p} {words(r.randrange(0, 80), (2, 9))}") for i, p in enumerate(passages) for j in range(3)]
    docs += [(100 + i, words(150, (2, 9))) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op8(spark, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == brute(docs, 400)
    lost = {x.doc_id: x.n_removed for x in got}
    long = [len(p) >= 400 for p in passages]
    assert 3 < sum(long) < len(long) and all((lost[3 * i + j] >= len(p)) == yes for i, (p, yes) in enumerate(zip(passages, long, strict=True)) for j in range(3))
    assert all(not n for d, n in lost.items() if d >= 100)
