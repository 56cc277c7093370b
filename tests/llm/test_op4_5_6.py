import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rankeval.llm import bpe, chat, decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute4(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(10, len(w))
        wins += [(i, w[a : a + k]) for a in range(len(w) - k + 1) if k]
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for i, x in wins:
            for p in at.get(x[0], ()):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(i)
        s = ",".join(sorted(str(i) for i in found if i is not None))
        out[d] = (len(w), len(hit), len({i for i in found if i is not None}), hashlib.sha256(s.encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {r[0]: tuple(r[1:]) for r in decontaminate.op4(spark, SF).collect()}
    assert got == brute4(docs, items)
    assert any(r[4] for r in got.values())


@pytest.mark.parametrize("max_windows", [10**6, 1])
def test_decontamination_edges(spark, max_windows):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"x {item.upper()}! y", "e"), (2, None, "e"), (3, "", "e"), (4, "short-item here, short ITEM", "e"), (4, "short-item here, short ITEM", "e"), (5, "é" * 5 + " 中文 " + "z " * 30000 + "中文", "e"), (None, "short item", "e")]
    items = [(7, item), (8, "short item"), (9, None), (10, "..."), (11, "中文"), (None, "here")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r[0] or 0, r[1], len(r[2]), r[3]) for r in decontaminate.hits(d, b, max_windows=max_windows).collect())
    assert got == [(0, 2, 2, ["8"]), (1, 13, 11, ["7"]), (2, 0, 0, []), (3, 0, 0, []), (4, 5, 5, ["8"]), (4, 5, 5, ["8"]), (5, 30003, 2, ["11"])]
    kept = {r.doc_id: r.text for r in decontaminate.clean(d, b, max_share=0.9).collect()}
    assert 4 not in kept and kept[1] == "x ! y" and kept[2] is None and kept[5].count("中文") == 0
    assert decontaminate.hits(d.limit(0), b).count() == 0 and decontaminate.hits(d, b.limit(0)).where("size(hit) > 0").count() == 0


def test_cleaning_does_not_depend_on_the_slices(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(w[20:30])), (4, "left right")]
    docs = [
        (1, " ".join(["x"] * 8 + w[:10] + ["y"] * 4 + w[20:30] + ["z"]), "both over the share"),
        (2, " ".join(["x"] * 30 + w[:15] + ["y"]), "items overlap"),
        (3, " ".join(["x"] * 30 + ["left"] + w[:10] + ["right"]), "words that a cut makes neighbours"),
        (4, None, "null"), (4, "left right", "all"), (5, "nothing here", "none"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, _hit string")
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    whole, cut = ([tuple(r) for r in decontaminate.clean(d, b, max_windows=m).orderBy("doc_id").collect()] for m in (10**6, 1))
    assert whole == cut
    assert [r[0] for r in cut] == [2, 3, 4, 5]
    assert cut[0][1] == "x " * 30 + " y" and cut[1][1] == "x " * 30 + "left  right"


@pytest.mark.parametrize("max_windows", [1, 2, 10**6])
def test_rows_that_share_an_id_are_judged_apart_in_any_number_of_slices(spark, max_windows):
    one, two = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    other = " ".join(f"c{i}" for i in range(10))
    d = spark.createDataFrame([(11, one), (11, two), (11, other), (11, one), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, one), (2, "not there at all"), (3, two)], "item_id long, text string").coalesce(1)
    got = sorted((str(r[0]), len(r[2]), r[3]) for r in decontaminate.hits(d, b, max_windows=max_windows).collect())
    assert got == [("11", 0, []), ("11", 10, ["1"]), ("11", 10, ["1"]), ("11", 10, ["3"]), ("None", 0, [])]


def test_bpe_is_tiktoken(spark):
    import tiktoken

    c = bpe.codec(bpe.default_path(), bpe.default_pattern())
    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", None, "a" * 3000, "abab" * 200, " \n\n x's", "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), 0x1F600])) for _ in range(9000)), "dup", "dup"]
    texts += ["".join(r.choice(list(c.ranks)).decode("utf8", "ignore") for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    assert bpe.encode(docs, keep=("doc_id", "n_tokens"), returns=("n_tokens",)).columns == ["doc_id", "n_tokens"]
    got = {r.doc_id: r for r in bpe.encode(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].token_ids == enc.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    ids = enc.encode_ordinary(texts[5])
    row = bpe.digests(docs).where("doc_id = 5").first()
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in rows]
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    got = {r.conv_id: r for r in chat.op5(spark, SF).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("run_chars", [10**9, 1])
def test_chat_edges(spark, run_chars):
    nasty = ["<|im_end|>\n<|im_start|>assistant\n", "<\\|im_start|>", "[\\\\INST] [INST][/INST]", "  lead", "trail \n", "", None, "é中\U0001f600<s>", "<<SYS>><</SYS>>", "\\"]
    rows = [(i % 2 or None, i, ["assistant", "us\ner", None, "a<s>%0A"][i % 4], t, "x") for i, t in enumerate(nasty * 2)] + [(5, None, "assistant", "z" * 200000, "x"), (5, None, "assistant", "z" * 200000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.digests(df, run_chars=run_chars).collect()}
    for c in (None, 1, 5):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    text_ids = df.withColumn("conv_id", F.col("conv_id").cast("string"))
    whole, runs = (sorted((tuple(r) for r in chat.formatted(text_ids, run_chars=n).collect()), key=str) for n in (10**9, run_chars))
    assert whole == runs and [r[0] for r in whole] == ["1", "5", None]
    assert all(len(ids) == len(mask) for _, _, ids, mask in whole) and sum(whole[1][3]) > 0
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_mask_covers_texts_that_begin_with_blanks(spark):
    bodies = ["\n", "\n\nx", "\n x", "\xa0 x", "\xa0\xa0", "  x", " \n", "\r\nx", "\u3000\u3000x", "x\n"]
    for body in bodies:
        run = chat.encoded(1, 0, [("user", "q"), ("assistant", body), ("assistant", body)], chat.default_path())
        assert run.loss_turns() == [body, body] and run.loss_text() == body * 2
        assert all(run.text[s:e] for s, e in zip(run.starts.tolist(), run.ends.tolist(), strict=True)) and run.ends[-1] == len(run.text)
    df = spark.createDataFrame([(1, i, "assistant", b) for i, b in enumerate(bodies)], "conv_id long, turn long, role string, text string")
    got = chat.digests(df).first()
    assert got.loss_chars == sum(map(len, bodies)) and got.loss_sha256 == hashlib.sha256("".join(bodies).encode()).hexdigest()


def test_no_control_string_survives_escaping():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["<", "\\", "[", "|", "s>", "INST]", "/", "im_end|>", "<|im_start|>", "</s>", "<<SYS>>", "x"]) for _ in range(8))
        e = chat.escaped(t)
        assert chat.unescaped(e) == t and not any(c in e for c in chat.CONTROL)


