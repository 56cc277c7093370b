"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant texts are met with the
token spans by binary search. A special token stands on either side of each text, and the encoder always splits there, so
no token is partly under the mask. Rows reach Python sorted by conversation and turn, as a stream. As every turn starts
and ends with a special token, the tokens of a conversation are those of its runs of whole turns, one after the other: the
encoder is fed run by run beyond ``run_chars``, so that digests() needs memory for a run and its longest turn alone, while
formatted() gives one row for each conversation, the same for any ``run_chars``.

Escaping: a control string C inside a role or text becomes C[0] + backslash + C[1:]; one that already has n backslashes
there gets n + 1. Unescaping takes one away, so every text comes back.

Defined results: a null or empty text is empty, a null role is an empty role; rows with the same turn are ordered by role
and text, nulls first; repeated rows are turns like others; a null conversation id is a conversation, ids may be of any
type that can be sorted; a very long text is one turn, encoded whole; an empty table has no conversations; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import mapped, table

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The control strings of common chat templates.
CONTROL = (OPEN, SEP, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
RUN_CHARS = 4_000_000
_rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_first = "[" + re.escape("".join(sorted({c[0] for c in CONTROL}))) + "]"
_ESCAPE = re.compile(rf"({_first})(\\*)({_rest})")
_UNESCAPE = re.compile(rf"({_first})\\(\\*)({_rest})")
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(SEP)}(.*?){re.escape(CLOSE)}\n", re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer with the template's markers as special tokens and offsets that keep leading blanks."""
    if path not in _encoders:
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (OPEN, SEP, CLOSE)])
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _encoders[path] = t
    return _encoders[path]


@dataclass
class Run:
    """Whole turns of one conversation: text, ids, the spans of the tokens and the mask."""

    conv: object
    number: int
    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    mask: np.ndarray
    last: bool = False

    def loss_text(self) -> str:
        """The text under the mask, read from the token spans."""
        out, at = [], 0
        for s, e in zip(self.starts[self.mask].tolist(), self.ends[self.mask].tolist(), strict=True):
            if e > at:  # the tokens of one character share its span
                out.append(self.text[max(s, at) : e])
                at = e
        return "".join(out)

    def turns(self) -> list[tuple[str, str]]:
        return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(self.text)]

    def loss_turns(self) -> list[str]:
        """The masked text of each assistant turn; a control string never spans two of them."""
        out = []
        for m in _TURN.finditer(self.text):
            if unescaped(m[1]) != "assistant":
                continue
            # the tokens that begin inside the turn's text, by binary search over the sorted starts
            a, b = np.searchsorted(self.starts, [m.start(2), m.end(2)])
            part = Run(None, 0, self.text, self.ids[a:b], self.starts[a:b], self.ends[a:b], self.mask[a:b])
            out.append(unescaped(part.loss_text()))
        return out


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the sorted spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}{SEP}", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def encoded(conv: object, number: int, turns: list[tuple[str, str]], path: str) -> Run:
    text, spans = rendered(turns)
    got = encoder(path).encode(text, add_special_tokens=False)
    offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
    ids, starts, ends = np.array(got.ids, np.int64), offsets[:, 0], offsets[:, 1]
    change = np.zeros(len(starts) + 1, np.int64)
    if spans:
        a, b = np.array(spans).T
        np.add.at(change, np.searchsorted(starts, a, "left"), 1)
        np.add.at(change, np.maximum(np.searchsorted(ends, b, "right"), np.searchsorted(starts, a, "left")), -1)
    return Run(conv, number, text, ids, starts, ends, np.cumsum(change[:-1]) > 0)


def runs(rows: Iterator[tuple[object, str, str]], path: str, run_chars: int = RUN_CHARS) -> Iterator[Run]:
    """Runs of (conversation, role, text) rows that come sorted. The last run of each conversation says so."""
    conv, turns, size, number = None, [], 0, 0
    for c, role, text in rows:
        if turns and (c != conv or size > run_chars):
            run = encoded(conv, number, turns, path)
            run.last = c != conv
            yield run
            turns, size, number = [], 0, 0 if run.last else number + 1
        conv = c
        turns.append((role or "", text or ""))
        size += len(text or "")
    if turns:
        run = encoded(conv, number, turns, path)
        run.last = True
        yield run


@dataclass
class Digest:
    """What is read back of a conversation from its runs."""

    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, run: Run) -> None:
        for role, text in run.turns():
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in run.loss_turns():
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(run.text)


def _sorted(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Rows:
    """(conversation, role, text) of every row, and the Arrow type of conversation ids."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.kind = batches, pa.null()

    def __iter__(self) -> Iterator[tuple[object, str, str]]:
        for batch in self.batches:
            self.kind = batch.schema.field(0).type
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)


def _joined(parts: list[Run]) -> Run:
    """The runs of one conversation as one."""
    edge = np.cumsum([0, *(len(r.text) for r in parts)])
    of = lambda name, by=0: np.concatenate([getattr(r, name) + x * by for r, x in zip(parts, edge, strict=False)])
    return parts[0] if len(parts) == 1 else Run(parts[0].conv, 0, "".join(r.text for r in parts), of("ids"), of("starts", 1), of("ends", 1), np.concatenate([r.mask for r in parts]), True)


def formatted(conversations: DataFrame, *, path: str | None = None, run_chars: int = RUN_CHARS) -> DataFrame:
    """conv_id, text, token_ids, loss_mask: one row for each conversation."""
    path, kind = path or default_path(), conversations.schema["conv_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = _Rows(batches), []
        for r in runs(rows, path, run_chars):
            parts.append(r)
            if r.last:
                r, parts = _joined(parts), []
                yield pa.RecordBatch.from_arrays([pa.array([r.conv], rows.kind), pa.array([r.text]), pa.array([r.ids], pa.list_(pa.int64())), pa.array([r.mask], pa.list_(pa.bool_()))], ["conv_id", "text", "token_ids", "loss_mask"])

    return mapped(_sorted(conversations), make, f"conv_id {kind}, text string, token_ids array<bigint>, loss_mask array<boolean>")


def digests(conversations: DataFrame, *, path: str | None = None, run_chars: int = RUN_CHARS) -> DataFrame:
    """conv_id and what is read back from the formatted runs, digested where they are made."""
    path, kind = path or default_path(), conversations.schema["conv_id"].dataType.simpleString()

    def pack(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        kinds = (("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, done, d = _Rows(batches), [], Digest()
        for r in runs(rows, path, run_chars):
            d.add(r)
            if r.last:
                done.append((r.conv, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.formatted_chars))
                d = Digest()
            if len(done) >= 1000:
                yield pack(done, rows.kind)
                done = []
        if done:
            yield pack(done, rows.kind)

    return mapped(_sorted(conversations), make, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation whose texts are control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def op5(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(rows.unionByName(probe))
