"""A versioned table of Parquet partitions, of which a commit writes only those that it touches.

A commit writes its partitions to a fresh folder with Spark's partitioned writer, and then a
marker file that names, for each partition of the new version, the folder that holds it.
Partitions that the commit didn't touch keep theirs, so nothing of them is read or written.
The marker is made whole under another name and then moved to its own, which only one writer
can do: the others raise CONFLICT.  A job that fails leaves an unnamed folder only.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphError

Part = tuple[str, ...]


class PartTable:
    """Versions of a table; keys are its partition columns, the last of them a number."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _files(self):
        """The Hadoop file system of the table, and a function from names to its paths."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs, at = self._files()
        place = at(folder) if folder else fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
        return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []

    def latest(self) -> int:
        return max((int(m[1]) for n in self._names("") if (m := re.fullmatch(r"version-(\d+)", n))), default=0)

    def marker(self, version: int) -> dict:
        """What a version's marker says: its settings, and its partitions by folder."""
        if not version:
            return {"settings": {}, "parts": {}}
        return json.loads(self.spark.read.text(f"{self.path}/version-{version}", wholetext=True).first()[0])

    def parts(self, version: int) -> dict[Part, str]:
        return {tuple(key): folder for folder, keys in self.marker(version)["parts"].items() for key in keys}

    def among(self, parts: list[Part]) -> Column:
        """Whether a row is of one of the partitions; decided by the scan from its folders' names."""
        numbers: dict[Part, list[int]] = {}
        for *head, last in sorted(parts):
            numbers.setdefault(tuple(head), []).append(int(last))
        return reduce(Column.__or__, [reduce(Column.__and__, [*(F.col(k) == v for k, v in zip(self.keys, head, strict=False)), F.col(self.keys[-1]).isin(last)]) for head, last in numbers.items()], F.lit(False))

    def read(self, schema: str, version: int, only: list[Part] | None = None) -> DataFrame:
        """The rows of a version (or of some of its partitions), with the partition columns."""
        wanted = None if only is None else set(only)
        frames = []
        for folder, keys in sorted(self.marker(version)["parts"].items()):
            held = [tuple(k) for k in keys if wanted is None or tuple(k) in wanted]
            if held:
                frames.append(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").where(self.among(held)))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[tuple[Part, int]]:
        """The partitions of rows, each with how many they are."""
        return [(tuple(str(r[k]) for k in self.keys), r["count"]) for r in rows.groupBy(*self.keys).count().collect()]

    def write(self, rows: DataFrame, base: int, replaced: list[Part] | None, settings: dict, order: list[str], shuffle: bool = True) -> int:
        """The version after base, in which rows are all that the replaced partitions hold (None: all partitions).

        Without a shuffle each task writes its rows as they come, into files of its own: for rows of which
        each task has few partitions, as it needs no disk beside the table.
        """
        if self.latest() != base:
            raise GraphError("CONFLICT", f"version {base} isn't the latest")
        folder = f"rows-{uuid.uuid4().hex}"
        # large partitions are split and small ones put together as they turn out, without a pass for samples
        rows = rows.hint("rebalance", *self.keys) if shuffle else rows
        rows.sortWithinPartitions(*self.keys, *order).write.option("compression", "zstd").partitionBy(*self.keys).parquet(f"{self.path}/{folder}")
        gone = set(replaced or ())
        kept: dict[str, list[Part]] = {}
        for key, place in self.parts(base).items() if replaced is not None else ():
            if key not in gone:
                kept.setdefault(place, []).append(key)
        if made := self._written(folder):
            kept[folder] = made
        self._claim(base + 1, json.dumps({"settings": settings, "parts": kept}))
        return base + 1

    def _written(self, folder: str) -> list[Part]:
        found: list[tuple[Part, str]] = [((), folder)]
        for key in self.keys:
            found = [((*part, unquote(name[len(key) + 1 :])), f"{at}/{name}") for part, at in found for name in self._names(at) if name.startswith(f"{key}=")]
        return [part for part, _ in found]

    def _claim(self, version: int, text: str) -> None:
        """Make a version's marker, or raise CONFLICT: by a link on a local disk, else by the file system's rename,
        which must be atomic and refuse a name that is taken, as HDFS's does."""
        jvm = self.spark._jvm
        fs, at = self._files()
        draft, final = at(f"draft-{uuid.uuid4().hex}"), at(f"version-{version}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        taken = GraphError("CONFLICT", f"version {version} was written meanwhile")
        try:
            if fs.getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(final), local(draft))
            elif not fs.rename(draft, final):
                raise taken
        except GraphError:
            raise
        except Exception as e:
            raise taken from e
        finally:
            fs.delete(draft, False)
