"""Tables that a job writes for its own later steps, or for later runs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_folders: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="rankeval-store-")
        _folders[app] = f"{root.rstrip('/')}/rankeval-store-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        delete(spark, folder)
    except Exception:  # the JVM may be gone by now
        pass


def delete(spark: SparkSession, folder: str) -> None:
    fs, p = hadoop_path(spark, folder)
    fs.delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and later uses see the same rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has added to the table since it was looked at."""


class Log:
    """A table that grows by whole parts. A part is a folder; it is there once its entry stands in the log.

    Entries are numbered and appear by a rename that fails where the number is taken, so of two writers that saw the same
    table one is refused, and what a killed writer left behind is never seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._schemas: dict[str, dict[str, str]] = {}

    def entries(self) -> list[dict]:
        """The parts in their order: `folder` and what commit() was given."""
        fs, p = hadoop_path(self.spark, f"{self.root}/_log")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(n)) | {"number": i} for i, n in enumerate(names)]

    def _read(self, name: str) -> str:
        fs, p = hadoop_path(self.spark, name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def new_folder(self) -> str:
        return f"{self.root}/part-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
        """Write df as table `name` of a part that is not committed yet, in folders by a column if asked, and read it."""
        out = df.write.partitionBy(by) if by else df.write
        out.parquet(f"{folder}/{name}")
        self._schemas.setdefault(folder, {})[name] = df.schema.json()
        return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def commit(self, folder: str, seen: int, **meta) -> None:
        """Let folder be part number seen, which is how many parts there were when it was made."""
        jvm = self.spark._jvm
        fs, draft = hadoop_path(self.spark, f"{self.root}/_log/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"folder": folder.rpartition("/")[2], "schemas": self._schemas.get(folder, {})} | meta), "utf-8"))
        out.close()
        entry = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_log/{seen:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, entry, none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.root}: part {seen} is there already") from None
            raise

    def table(self, name: str, entries: list[dict] | None = None) -> DataFrame | None:
        """Table `name` of all parts together, or of some; None without any."""
        out = None
        for e in self.entries() if entries is None else entries:
            part = self.spark.read.schema(StructType.fromJson(json.loads(e["schemas"][name]))).parquet(f"{self.root}/{e['folder']}/{name}")
            out = part if out is None else out.unionByName(part)
        return out


def signature(*tables: DataFrame) -> str:
    """A digest of the files behind tables: their paths, lengths and times."""
    found = []
    for t in tables:
        for file in sorted(t.inputFiles()):
            fs, p = hadoop_path(t.sparkSession, file)
            s = fs.getFileStatus(p)
            found.append((file, s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()[:32]
