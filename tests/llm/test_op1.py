import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rankeval.llm import components, ngram_join

SPLIT = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPLIT:
            out.append(now)
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return [w for w in [*out, now] if w]


def brute(docs, k, percent):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    groups = ngram_join.Groups(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                groups.join(i, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = groups.find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), least.get(groups.find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(60)]
    passage = [r.choice(vocab) for _ in range(25)]
    docs = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.7:
            w = [r.choice(vocab) for _ in range(r.randrange(1, 40))] + passage
        elif kind < 0.8 and docs:
            w = (r.choice(docs)[1] or "").split()
            w = w[: r.randrange(1, len(w) + 1)] if w else w
        else:
            w = [r.choice(vocab[:20]) for _ in range(r.randrange(0, 9))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,k,percent,rows", [(1, 3, 90, 4000), (2, 5, 80, 10)])
def test_against_brute_force(spark, seed, k, percent, rows):
    docs = corpus(seed)
    docs += [(500, None), (501, ""), (502, " \n\t "), (503, "One  TWO"), (504, "one two"), (504, "one two"), (None, docs[0][1]), (505, "é É x"), (506, "lang " * 9000 + "end")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_shingles int")
    got = sorted((tuple(r) for r in ngram_join.components(df, k=k, percent=percent, table_rows=rows).collect()), key=str)
    assert got == brute(docs, k, percent)


def test_one_of_each_and_empty(spark):
    docs = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (None, "a b c d e f"), (4, None), (5, None)]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, component_id string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted([df.collect()[i] for i in (0, 2, 3, 4, 5)], key=str)
    assert ngram_join.components(df.limit(0)).count() == 0


def test_table_links_join_exactly_the_similar():
    r = np.random.default_rng(5)
    base = np.sort(r.integers(0, 2**60, 80).astype(np.uint64))
    sets = [base]
    for _ in range(60):
        keep = base[r.random(80) > r.choice([0.02, 0.06, 0.1])]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 40, r.integers(0, 6)).astype(np.uint64)])))
    got, want = ngram_join.Groups(61), ngram_join.Groups(61)
    for i, j in ngram_join.table_links(sets[0], iter(sets[1:]), 90):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)
        got.join(i, j)
    for i in range(61):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [got.find(i) for i in range(61)] == [want.find(i) for i in range(61)]


def test_similar_sets_share_what_their_prefixes_promise():
    r = np.random.default_rng(2)
    sketch = np.zeros(1 << ngram_join.SKETCH_BITS, np.float32)
    sets = [np.unique(r.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(3)]
    sets += [np.unique(np.concatenate([s[r.permutation(len(s))[:46]], r.integers(0, 2**64, 2, dtype=np.uint64)])) for s in sets for _ in range(20)]
    for s in sets:
        sketch += np.bincount(ngram_join._slot(s), minlength=len(sketch))
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                (m, x), (n, y) = ngram_join.prefix(a, sketch, 0, 80), ngram_join.prefix(b, sketch, 0, 80)
                assert len(np.intersect1d(x, y)) >= min(m, n)


def test_chain_is_one_component(spark):
    n = 40
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.connected(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.connected(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed,k,percent,rows", [(1, 3, 90, 4000), (2, 5, 80, 10), (3, 3, 70, 7)])
def test_links_are_counted_as_by_brute_force(spark, seed, k, percent, rows):
    docs = corpus(seed)
    docs += [(500, None), (501, ""), (503, "One  TWO"), (504, "one two"), (504, "one two"), (None, docs[0][1])]
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    want = sorted(((d, sum(i != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets))) for i, ((d, _), a) in enumerate(zip(docs, sets, strict=True))), key=str)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.components(df, k=k, percent=percent, table_rows=rows, n_links=True)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == want
    assert max(n for _, n in want) > 10


def test_query_returns_the_number_of_links(spark):
    out = ngram_join.op1(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    sizes = {r.component_id: r["count"] for r in out.groupBy("component_id").count().collect()}
    assert all((r.n_links > 0) == (sizes[r.component_id] > 1) for r in out.collect())


def test_a_table_holds_the_differences_of_its_guests_not_their_sets(monkeypatch):
    r = random.Random(0)
    base = [f"w{i}" for i in range(4000)]
    monkeypatch.setattr(ngram_join, "mapped", lambda rows, run, schema: run)
    of = lambda text: next(ngram_join.shingle_sets([text.encode()], 5))
    centre = ngram_join.digest(of(" ".join(base)))

    def batches(n):
        for i in range(0, n, 20):
            texts = [" ".join(base if j == 0 else [*base[: (at := r.randrange(4000))], f"new{j}", *base[at + 1 :]]) for j in range(i, i + 20)]
            nodes = [ngram_join.digest(of(t)) for t in texts]
            yield pa.record_batch([[centre] * 20, [0] * 20, [0] * 20, [node != centre for node in nodes], nodes, texts], ["centre", "b1", "b2", "guest", "node", "text"])

    def peak(n):
        tracemalloc.start()
        found = pa.Table.from_batches(ngram_join._table_links(None, 5, 80, False)(batches(n)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.num_rows == n - 1
        return most

    peak(20)
    assert peak(1500) - peak(300) < 1200 * 4000 * 8 / 2  # of hashes in the sets of 1,200 more guests


def test_a_table_without_its_centre_has_no_links(monkeypatch):
    monkeypatch.setattr(ngram_join, "mapped", lambda rows, run, schema: run)
    texts = ["a b c d e f", "a b c d e f g", "a b c d e f g h"]
    nodes = [ngram_join.digest(next(ngram_join.shingle_sets([t.encode()], 2))) for t in texts]

    def links(rows):
        columns = [[nodes[0]] * len(rows), [0] * len(rows), [0] * len(rows), [i > 0 for i in rows], [nodes[i] for i in rows], [texts[i] for i in rows]]
        batch = pa.record_batch(columns, ["centre", "b1", "b2", "guest", "node", "text"])
        return [x for out in ngram_join._table_links(None, 2, 80, False)(iter([batch])) for x in zip(*(out.column(c).to_pylist() for c in "uv"), strict=True)]

    assert links([1, 2]) == []
    assert {frozenset(x) for x in links([0, 1, 1, 2])} == {frozenset(nodes[:2]), frozenset(nodes[1:])}
