"""File trees of git repositories as tables: a Python data source over local clones, and how trees meet blobs."""

from __future__ import annotations

import contextlib
import itertools
import json
import queue
import subprocess
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from rankeval.functions.text import is_source
from rankeval.session import ship


class CommitUnavailable(LookupError):
    """The clone, the commit or the blob is not there."""


def git(clone: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", clone, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise CommitUnavailable(f"{clone}: {done.stderr.decode(errors='replace').strip()[:200]}")
    return done.stdout


def slug(repo: str) -> str:
    return repo.replace("/", "__")


def has_clone(root: str, repo: str) -> bool:
    return Path(root, slug(repo)).is_dir()


def has_commit(root: str, repo: str, commit: str) -> bool:
    return has_clone(root, repo) and not subprocess.run(["git", "-C", f"{root}/{slug(repo)}", "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True).returncode


def read_blob(root: str, repo: str, blob: str) -> str:
    """One content by its hash; CommitUnavailable if it is not there. Bytes that are no UTF-8 become U+FFFD."""
    return git(f"{root}/{slug(repo)}", "cat-file", "blob", blob).decode(errors="replace")


def read_file(root: str, repo: str, commit: str, path: str) -> str:
    """One file as it was at a commit; CommitUnavailable if either is not there."""
    return read_blob(root, repo, f"{commit}:{path}")


def listing(root: str, repo: str, commit: str, cache: str | None = None) -> list[tuple[str, str]]:
    """(path, blob) of every file at a commit, submodules left out.

    With cache (a folder) a listing is kept there: a commit's tree never changes, so an entry stays right. Entries appear
    whole, by a rename of a file of their own; one that can't be read is made again.
    """
    entry = Path(cache, slug(repo), f"{commit}.json") if cache else None
    if entry:
        with contextlib.suppress(OSError, ValueError):
            return [(p, b) for p, b in json.loads(entry.read_text())]
    out = []
    for line in git(f"{root}/{slug(repo)}", "ls-tree", "-r", "-z", commit).decode(errors="replace").split("\0"):
        meta, _, path = line.partition("\t")
        if path and meta.split()[1] == "blob":
            out.append((path, meta.split()[2]))
    if entry:
        entry.parent.mkdir(parents=True, exist_ok=True)
        own = entry.with_name(f"{entry.name}.{uuid.uuid4().hex}")
        own.write_text(json.dumps(out))
        own.replace(entry)
    return out


def code_version(root: str) -> str:
    """Short commit, -dirty with uncommitted changes; unknown outside a repository."""
    try:
        return git(root, "rev-parse", "--short", "HEAD").decode().strip() + ("-dirty" if git(root, "status", "--porcelain").strip() else "")
    except (CommitUnavailable, OSError):
        return "unknown"


class Streamed:
    """Contents of a clone's objects, one after the other, from one running git: only the content at hand is in memory."""

    def __init__(self, clone: str, names: Iterable[str]):
        self.clone, self.names = clone, names

    def __iter__(self) -> Iterator[tuple[str, bytes]]:
        """(name, content); objects that are not there are left out."""
        run = subprocess.Popen(["git", "-C", self.clone, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        asked: queue.Queue = queue.Queue()

        def ask() -> None:
            with contextlib.suppress(OSError), run.stdin as pipe:
                for n in self.names:
                    asked.put(n)
                    pipe.write(f"{n}\n".encode())
            asked.put(None)

        feeder = threading.Thread(target=ask, daemon=True)
        feeder.start()
        try:
            while (name := asked.get()) is not None:
                head = run.stdout.readline().split()
                if not head:
                    raise CommitUnavailable(f"{self.clone}: git ended early")
                if head[-1] == b"missing":
                    continue
                content = run.stdout.read(int(head[2]))
                run.stdout.read(1)
                yield name, content
        finally:
            run.stdout.close()
            run.kill()
            run.wait()


class _Part(InputPartition):
    """Commits of one repository, and which slice of their objects."""

    def __init__(self, repo: str, commits: list[str], number: int = 0, slices: int = 1):
        self.repo, self.commits, self.number, self.slices = repo, commits, number, slices


class _Reader(DataSourceReader):
    def __init__(self, options: dict, with_text: bool):
        self.root, self.pins, self.with_text = options["root"], [x.split("@") for x in options["pins"].split(",") if x], with_text
        self.cache, self.slices = options.get("cache"), int(options.get("slices", 8))
        self.path = lambda p: True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """repo and commit choose among the pins; path, as one of some or by its start, is looked at while a tree is listed."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            one = isinstance(f, (EqualTo, In))
            values = ([f.value] if isinstance(f, EqualTo) else list(f.value)) if one else []
            if one and column == "repo":
                self.pins = [p for p in self.pins if p[0] in values]
            elif one and column == "commit" and not self.with_text:
                self.pins = [p for p in self.pins if p[1] in values]
            elif one and column == "path":
                self._also(lambda p, values=frozenset(values): p in values)
            elif isinstance(f, StringStartsWith) and column == "path":
                self._also(lambda p, start=f.value: p.startswith(start))
            elif not isinstance(f, IsNotNull):  # no value is ever null
                yield f

    def _also(self, holds: Callable[[str], bool]) -> None:
        before = self.path
        self.path = lambda p: before(p) and holds(p)

    def partitions(self):
        if not self.with_text:
            return [_Part(repo, [commit]) for repo, commit in self.pins] or [_Part("", [])]
        by_repo: dict[str, list[str]] = {}
        for repo, commit in self.pins:
            by_repo.setdefault(repo, []).append(commit)
        return [_Part(repo, commits, i, self.slices) for repo, commits in by_repo.items() for i in range(self.slices)] or [_Part("", [])]

    def read(self, part: _Part):
        trees = ((c, listing(self.root, part.repo, c, self.cache)) for c in part.commits)
        if not self.with_text:
            yield from ((part.repo, c, p, b) for c, entries in trees for p, b in entries if self.path(p))
            return
        names = dict.fromkeys(b for _, entries in trees for _, b in entries if int(b[:8], 16) % part.slices == part.number)
        if names:
            for name, content in Streamed(f"{self.root}/{slug(part.repo)}", names):
                yield part.repo, name, content.decode(errors="replace")


class GitTree(DataSource):
    """spark.read.format("git_tree").option("root", clones).option("pins", "owner/name@commit,...").load()

    With option("cache", folder) listings are kept and read from there. Clones and that folder must be mounted alike on
    all machines. Filters on repo, commit and path reach the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo string, commit string, path string, blob string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)


class GitBlobs(DataSource):
    """The contents of the same trees, each once a repository, in option("slices", 8) partitions of it by their hashes."""

    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return "repo string, blob string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


def register(spark: SparkSession) -> None:
    """Make both formats known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitTree)
    spark.dataSource.register(GitBlobs)


def trees(pins: DataFrame, root: str, cache: str | None = None) -> DataFrame:
    """(repo, commit, path, blob) of the commits in a table (repo, commit), a task for each few of them."""
    ship(pins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, commit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = listing(root, repo, commit, cache)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([repo] * n, pa.string()), pa.array([commit] * n, pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["repo", "commit", "path", "blob"])

    return pins.select("repo", "commit").distinct().repartition("repo", "commit").mapInArrow(run, "repo string, commit string, path string, blob string")


def contents(wanted: DataFrame, root: str) -> DataFrame:
    """(repo, blob, text) of the objects in a table (repo, blob), each once; those that are not there are left out.

    The objects of a repository, however few commits name them, are dealt out over all tasks; each runs one git a
    repository and holds one content at a time.
    """
    ship(wanted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, b) for batch in batches for r, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for repo, own in itertools.groupby(rows, key=lambda x: x[0]):
            for name, content in Streamed(f"{root}/{slug(repo)}", (b for _, b in own)):
                yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([name]), pa.array([content.decode(errors="replace")], pa.string())], ["repo", "blob", "text"])

    rows = wanted.select("repo", "blob").where("repo is not null and blob is not null").distinct()
    return rows.repartition("repo", "blob").sortWithinPartitions("repo").mapInArrow(run, "repo string, blob string, text string")


def source_files(tree: DataFrame) -> DataFrame:
    return tree.where(is_source("path"))


def wanted_blobs(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that the tree holds, each once however many paths and commits share it; missing ones are left out."""
    return blobs.join(tree.select("blob").distinct(), "blob", "left_semi")
