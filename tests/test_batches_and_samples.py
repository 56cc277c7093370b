import random

import pytest

from rankeval.operators import batching, sampling


def greedy(lengths, budget, most):
    out, now, held = [], [], 0
    for t in sorted(lengths):
        if now and (held + t > budget or len(now) >= most):
            out.append(now)
            now, held = [], 0
        now.append(t)
        held += t
    return [*out, now] if now else out


@pytest.mark.parametrize("seed,budget,most", [(1, 100, 8), (2, 30, 64), (3, 10, 3), (4, 1000, 1)])
def test_batches_are_the_greedy_ones(spark, seed, budget, most):
    r = random.Random(seed)
    lengths = [r.choice([0, 1, 1, 7, 7, 7, r.randrange(60)]) for _ in range(400)]
    df = spark.createDataFrame([(i, None if t == 0 and i % 2 else t, "x") for i, t in enumerate(lengths)], "id int, tokens int, batch_name string").repartition(5)
    got = batching.batched(df, key="id", tokens="tokens", budget=budget, most=most)
    assert got.columns == [*df.columns, "batch"] and sorted(x.id for x in got.collect()) == list(range(400))
    held = {}
    for x in got.collect():
        held.setdefault(x.batch, []).append(x.tokens or 0)
    want = greedy(lengths, budget, most)
    assert [sorted(held[i]) for i in range(len(held))] == want
    for own, behind in zip(want, want[1:], strict=False):
        assert (sum(own) <= budget or len(own) == 1) and (sum(own) + behind[0] > budget or len(own) == most)
    rates = batching.rates(got.fillna(0), "tokens").first()
    assert rates.batches == len(want) and rates.fullest == max(map(sum, want)) and rates["median"] == sorted(map(sum, want))[len(want) // 2]
    assert batching.batched(df.limit(0), key="id", tokens="tokens", budget=budget, most=most).count() == 0


def test_reservoir_is_uniform():
    """Chi-square over seeds: every row of two unequal partitions comes equally often, alone and in pairs."""
    n, k, rounds, hits, pairs = 12, 3, 6000, [0] * 12, {}
    for seed in range(rounds):
        keyed = []
        for at, sizes in ((0, (1, 2, 1)), (4, (8,))):
            one, start = sampling.Reservoir(k, random.Random(f"{seed}:{at}")), at
            for size in sizes:
                keyed += [(key, start + i) for i, key in zip(*one.push(size), strict=True)]
                start += size
        chosen = sorted(i for _, i in sorted(keyed)[:k])
        assert len(set(chosen)) == k
        for i in chosen:
            hits[i] += 1
        for a in range(k):
            for b in range(a):
                pairs[chosen[b], chosen[a]] = pairs.get((chosen[b], chosen[a]), 0) + 1
    mean = rounds * k / n
    assert sum((h - mean) ** 2 / mean for h in hits) < 31  # 11 degrees of freedom, 0.1 %
    mean = rounds * 3 / 66
    assert len(pairs) == 66 and sum((h - mean) ** 2 / mean for h in pairs.values()) < 108  # 65 degrees, 0.1 %


def test_reservoir_skips_rows():
    one = sampling.Reservoir(5, random.Random(1))
    entered = sum(len(one.push(10_000)[0]) for _ in range(100))
    assert 5 < entered < 150  # about 5 + 5 log(1,000,000 / 5)


def test_reservoir_of_tables(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][min(2, i // 60)] if i < 125 else "one") for i in range(126)], "id int, g string").repartition(6, "id")
    got = sampling.reservoir(df, 10, seed=1, group="g").collect()
    by = {}
    for x in got:
        by.setdefault(x.g, set()).add(x.id)
    assert {g: len(v) for g, v in by.items()} == {"a": 10, "b": 10, None: 5, "one": 1}
    assert {x.id for x in sampling.reservoir(df, 10, seed=1).collect()} == {x.id for x in sampling.reservoir(df, 10, seed=1).collect()}
    assert {x.id for x in sampling.reservoir(df, 10, seed=1).collect()} != {x.id for x in sampling.reservoir(df, 10, seed=2).collect()}
    assert sampling.reservoir(df, 500, seed=1).count() == 126 and sampling.reservoir(df, 0, seed=1).count() == 0
    assert sampling.reservoir(df.limit(0), 5, seed=1, group="g").count() == 0
