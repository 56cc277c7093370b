import hashlib
import random
from collections import Counter

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rankeval.llm import bpe, labelled, toxicity
from tests.llm.test_op1 import words
from tests.llm.test_op4_5_6 import WORD, lower

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def near_copies(docs):
    sets = {}
    for d, t in docs.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, equal = {}, {}
    for d in sorted(docs):
        first = equal.setdefault(frozenset(sets[d]), d) if sets[d] else d
        shared = {first: len(sets[d])} if first != d else Counter(o for s in sets[d] for o in held.get(s, ()))
        for o, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[o]) - n) and find(d) != find(o):
                a, b = sorted((find(d), find(o)))
                root[b] = a
        for s in sets[d] if first == d else ():
            held.setdefault(s, []).append(d)
    return {d for d in docs if find(d) != d}


def brute(spark):
    """The same decisions in plain Python, on the trained model's scores."""
    docs = raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(labelled.training_texts(table, spark.read.parquet(f"{SF}/labels.parquet"), "toxic", toxicity.PER_CLASS))
    docs = {d: t for d, t in docs.items() if next(toxicity.scored([t.encode()], model))[1] < toxicity.THRESHOLD}
    yield set(docs)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(BLANK))
    first, many = {}, {}
    for d in sorted(docs):
        for k in {key(x) for x in docs[d].split("\n")}:
            first.setdefault(k, d)
            many[k] = many.get(k, 0) + 1
    docs = {d: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 10 and many[key(x)] > 1 and first[key(x)] != d)) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if t == raw[d] or t.strip(BLANK)}
    yield {d: hashlib.md5(t.encode()).hexdigest() for d, t in docs.items()}
    gone = near_copies(docs) | near_copies({d: raw[d] for d in docs})
    docs = {d: t for d, t in docs.items() if d not in gone}
    yield set(docs)
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    out = {}
    for d, t in docs.items():
        low = lower(t)
        at = [m.span() for m in WORD.finditer(low)]
        w = [low[a:b] for a, b in at]
        hit = {p for n, ws in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in ws for p in range(i, i + n)}
        if len(hit) > 0.5 * len(w):
            continue
        gone = {c for p in hit for c in range(at[p][0], at[p + 1][0] if p + 1 in hit else at[p][1])}
        out[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    yield {d: hashlib.md5(t.encode()).hexdigest() for d, t in out.items()}
    yield out


def test_stages_against_brute_force(spark, monkeypatch):
    """Every stage of one run, seen as it is written."""
    want, columns, kept = brute(spark), spark.read.parquet(f"{SF}/documents.parquet").columns, []

    def seen(df, name):
        kept.append((name, out := staged(df, name)))
        return out

    staged = corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", seen)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert [name for name, _ in kept] == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    for _, docs in kept:
        rows, expected = docs.collect(), next(want)
        assert docs.columns == columns and len(rows) == len(expected)
        if isinstance(expected, set):
            assert {r.doc_id for r in rows} == expected
        else:
            assert {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in rows} == expected
            assert all(r.n_chars == len(r.text) for r in rows if r.text)
    texts = next(want)
    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.codec(bpe.default_path(), bpe.default_pattern()).ranks, special_tokens={})
    assert set(got) == set(texts) and len(texts) > 700
    for d, t in texts.items():
        assert got[d].token_ids == enc.encode_ordinary(t) and got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_with_odd_rows(spark):
    line = "A line that several documents hold."
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, hit string, score string"
    rows = [(1, f"{line}\nfirst", "en", "s", 5, "x", "x", "x"), (2, f"{line}\nsecond", None, None, None, None, None, None), (2, f"{line}\nsecond", None, None, None, None, None, None), (None, "no id here", "en", "s", 1, "x", "x", "x"), (3, None, "en", "s", 1, "x", "x", "x"), (4, "", "en", "s", 0, "x", "x", "x"), (5, "word " * 30000, "en", "s", 1, "x", "x", "x")]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert out.columns == docs.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "2", "2", "3", "4", "5", "None"], name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        docs = out
    texts = {r.doc_id: (r.text, r.n_lines) for r in docs.collect()}
    assert texts[1] == (f"{line}\nfirst", "x") and texts[2] == ("second", None) and texts[3][0] is None and texts[4][0] == ""
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == 7 and last.where("doc_id in (3, 4)").agg({"n_tokens": "sum"}).first()[0] == 0


def test_copies_behind_line_dedup(spark, tmp_path):
    """Exact copies go as emptied documents, near copies that keep their lines go to the join, blank texts stay."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    rows = [(i, "\n".join(line() for _ in range(3))) for i in range(20)]
    rows += [(100 + i, rows[i][1].replace("\n", " x\n") + " y") for i in range(10)]
    rows += [(200, rows[0][1]), (201, "  "), (202, None), (203, rows[1][1].upper() + "\n\n \t")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cut = corpus_pipeline.drop_repeated_lines(spark, docs, "").cache()
    assert {x.doc_id for x in cut.collect()} == {d for d, _ in rows} - {200, 203}
    kept = corpus_pipeline.drop_near_copies(spark, cut, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {*range(20), 201, 202}


def test_near_copies_go_though_their_lines_were_cut(spark, tmp_path):
    """Planted copies with a few words changed on one line: the stage behind line dedup finds them by their raw texts."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(10))) for i in range(60)]
    rows += [(100 + i, rows[i][1].rpartition("\n")[0] + "\n" + line()[:20] + rows[i][1].rpartition("\n")[2][20:]) for i in range(30)]
    rows += [(200, rows[0][1]), (201, "  "), (202, None), (None, "without an id"), (300, rows[50][1] + "\nof one id"), (300, rows[51][1] + "\nof one id too")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cut = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).cache()
    assert {x.doc_id for x in cut.collect()} == {d for d, _ in rows} - {200}
    kept = corpus_pipeline.drop_near_copies(spark, cut, str(tmp_path))
    # An id of several raw documents is compared as it comes.
    assert kept.columns == docs.columns and sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == [-1, *range(60), 201, 202, 300, 300]
    # Rows that are not left of the raw documents are compared as they come.
    other = docs.where("doc_id between 100 and 202").withColumn("text", F.concat(F.lit("other "), F.col("doc_id").cast("string")))
    assert corpus_pipeline.drop_near_copies(spark, other, str(tmp_path)).count() == 33
