"""Calls to a remote model from executors, through an injected function; retries, waits and the local settings they need."""

from __future__ import annotations

import os
import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.session import ship
from rankeval.sources.store import Conflict, Log

#: HTTP states worth another try, the number of tries, and the waits in seconds.
RETRY = frozenset({408, 429, 500, 502, 503, 504})
TRIES, FIRST_WAIT, LONGEST_WAIT = 8, 2.0, 120.0

#: Fixed value: seconds after which a call that has not answered is given up.
DEADLINE = 300.0

REPLY = "key string, text string, cost double, finish_reason string, provider string, output_tokens int, reasoning_tokens int"
#: What a reply took besides.
TRIED = f"{REPLY}, retries int"
ARROW = {c.split()[0]: {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]] for c in TRIED.split(", ")}


@dataclass(frozen=True)
class Reply:
    status: int
    body: dict
    retry_after: float | None = None


class RemoteError(RuntimeError):
    """No usable reply after all tries."""


class MissingKey(RemoteError):
    """The setting that holds the API key is not there, or empty."""


class BudgetSpent(RemoteError):
    """The next call would go over the budget."""


def api_key(name: str) -> str:
    if key := os.environ.get(name, "").strip():
        return key
    raise MissingKey(f"{name} is not set")


def within_budget(spent: float, calls: int, cap: float) -> None:
    """Refuse a call that would, at the mean price so far, go over the cap."""
    if spent >= cap or (calls and spent + spent / calls > cap):
        raise BudgetSpent(f"{spent:.4f} of {cap:.4f} spent by {calls} calls")


def wait_before(attempt: int, retry_after: float | None = None) -> float:
    """Seconds before try attempt + 2: twice as long each time, unless the other side says when."""
    return retry_after if retry_after is not None else min(FIRST_WAIT * 2**attempt, LONGEST_WAIT)


def within(seconds: float, call: Callable, *args):
    """call(*args), or TimeoutError if it has not ended by then; a call that is given up goes on in a thread of its own."""
    out: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            out.put((call(*args), None))
        except BaseException as e:
            out.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = out.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no reply after {seconds:g} s") from None
    if error:
        raise error
    return value


def send(call: Callable[[], Reply], sleep: Callable[[float], None] = time.sleep, deadline: float | None = None, retried: Callable[[], None] = lambda: None) -> dict:
    """The body of the first usable reply. A body that reports an error code of RETRY counts like that status.

    With a deadline each try is given up after so many seconds, and tried again. retried is called before every new try.
    """
    last = ""
    for attempt in range(TRIES):
        after = None
        try:
            r = within(deadline, call) if deadline else call()
            code = (r.body.get("error") or {}).get("code", r.status) if r.status == 200 else r.status
            if code == 200:
                return r.body
            last, after = f"status {code}", r.retry_after
            if code not in RETRY:
                raise RemoteError(last)
        except (ConnectionError, TimeoutError) as e:
            last = str(e)
        if attempt + 1 < TRIES:
            retried()
            sleep(wait_before(attempt, after))
    raise RemoteError(f"{TRIES} tries: {last}")


def replies(requests: DataFrame, call: Callable[[str], dict]) -> DataFrame:
    """Replies (REPLY) to requests (key, prompt); call runs on the executors and goes through send() itself."""
    names = [c.split()[0] for c in REPLY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"key": k} | call(p) for k, p in zip(batch["key"], batch["prompt"], strict=True)], columns=names)

    ship(requests.sparkSession)
    return requests.select("key", "prompt").mapInPandas(run, REPLY)


def asked(requests: DataFrame, call: Callable[[str], Reply], *, at_once: int = 4, deadline: float = DEADLINE, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Replies (TRIED) to requests (key, prompt) by one raw call each, with send()'s tries: at_once of them at a time in a task.

    The body of a reply has the columns of REPLY but the key.
    """
    names = [c.split()[0] for c in TRIED.split(", ")]

    def one(key: str, prompt: str) -> dict:
        tries: list[None] = []
        body = send(lambda: call(prompt), sleep, deadline, lambda: tries.append(None))
        return {"key": key, "retries": len(tries)} | {c: body.get(c) for c in names[1:-1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ARROW[c]) for c in names], names)

    ship(requests.sparkSession)
    return requests.select("key", "prompt").mapInArrow(run, TRIED)


def answered(requests: DataFrame, call: Callable[[str], Reply], root: str, *, waves: int = 8, **how) -> DataFrame:
    """requests with the reply of their key and `cached`, whether it was there before. Replies are stored below root.

    Requests go out in waves by a hash of their key; a wave's replies are stored when it ends, so a run that dies loses one
    wave, and a run over the same requests calls nothing. A reply without a text is asked for again.
    """
    spark = requests.sparkSession
    log = Log(spark, root)
    before = log.entries()
    for wave in range(waves):
        mine = requests.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).select("key", "prompt").dropDuplicates(["key"])
        entries = log.entries()
        if entries:
            mine = mine.join(log.table("replies", entries).where("text is not null").select("key"), "key", "left_anti")
        if mine.isEmpty():
            continue
        part = log.new_folder()
        n = log.write(asked(mine, call, **how), part, "replies").count()
        while True:
            try:
                log.commit(part, len(log.entries()), calls=n)
                break
            except Conflict:  # another run has stored replies of its own; these are as good
                continue
    last = log.table("replies")
    if last is None:
        return requests.join(spark.createDataFrame([], f"{TRIED}, cached boolean"), "key", "left")
    numbered = None
    for e in log.entries():
        part = log.table("replies", [e]).withColumns({"_n": F.lit(e["number"]), "cached": F.lit(e["number"] < len(before))})
        numbered = part if numbered is None else numbered.unionByName(part)
    names = [c for c in last.columns if c != "key"]
    best = numbered.groupBy("key").agg(F.max_by(F.struct(*names, "cached"), F.struct(F.col("text").isNotNull(), -F.col("_n"))).alias("r"))
    return requests.join(best, "key", "left").select(*requests.columns, *(F.col(f"r.{c}").alias(c) for c in [*names, "cached"]))


def counters(answers: DataFrame) -> DataFrame:
    """One row over answered(): calls and their retries and cost, replies that were there, and such as are cut short or empty."""
    first = answers.groupBy("key").agg(F.first(F.struct("text", "cost", "finish_reason", "retries", "cached")).alias("r")).select("r.*")  # a key is asked once
    live = F.col("cached") == False  # noqa: E712
    return first.agg(
        F.count_if(live).alias("calls"), F.count_if("cached").alias("cache_hits"), F.coalesce(F.sum(F.when(live, F.col("retries"))), F.lit(0)).cast("long").alias("retries"),
        F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"),
        F.round(F.coalesce(F.sum(F.when(live, F.col("cost"))), F.lit(0.0)), 6).alias("spent"),
    )


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file into the environment, which wins; blank lines, comments and quotes aside."""
    out = {}
    for line in Path(path).read_text().splitlines() if Path(path).is_file() else ():
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    for k, v in out.items():
        os.environ.setdefault(k, v)
    return out
