"""A split as a file: written once, then read and never computed again."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A split's sides as they stand in the file, and as queries name them.
SIDES = {"dev": "dev", "test": "test", "ci_slice": "ci"}


class SplitFileError(ValueError):
    """The file is no split, or its counts are not those of its lists."""


@dataclass(frozen=True)
class Split:
    dataset: str
    revision: str
    seed: int
    dev: tuple[str, ...]
    test: tuple[str, ...]
    ci_slice: tuple[str, ...]

    def rows(self, spark: SparkSession, key: str = "instance_id") -> DataFrame:
        """(key, side, ord): the ids of each side in the file's order. A split is a list of chosen ids, held by the driver anyway."""
        rows = [(i, name, n) for side, name in SIDES.items() for n, i in enumerate(getattr(self, side))]
        return spark.createDataFrame(rows, T.StructType([T.StructField(key, T.StringType()), T.StructField("side", T.StringType()), T.StructField("ord", T.LongType())]))


def of_table(sides: DataFrame, *, dataset: str, revision: str, seed: int, key: str = "instance_id") -> Split:
    """The split of a table (key, side), ids sorted; side is dev, test or ci."""
    held = {r.side: tuple(r.ids) for r in sides.groupBy("side").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("ids")).collect()}
    return Split(dataset, revision, seed, *(held.get(name, ()) for name in SIDES.values()))


def dumped(split: Split) -> str:
    """JSON with the keys always in one order and a line for each id, so that two files can be compared by line."""
    head = {"dataset": split.dataset, "revision": split.revision, "seed": split.seed}
    sizes = {f"{side}_count": len(getattr(split, side)) for side in SIDES}
    return json.dumps(head | sizes | {side: list(getattr(split, side)) for side in SIDES}, indent=2)


def write(split: Split, path: str) -> None:
    Path(path).write_text(dumped(split) + "\n")


def read(path: str) -> Split:
    try:
        raw = json.loads(Path(path).read_text())
        split = Split(raw["dataset"], raw["revision"], raw["seed"], *(tuple(raw[side]) for side in SIDES))
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise SplitFileError(f"{path}: {e}") from e
    for side in SIDES:
        if raw.get(f"{side}_count", len(raw[side])) != len(raw[side]):
            raise SplitFileError(f"{path}: {side} has {len(raw[side])} ids, not {raw[f'{side}_count']}")
    return split
