"""Tables that change together, one numbered version at a time, with a single visible switch.

A change writes the new rows of every table into folders of the next number and then, last, one small
file with that number. Readers look at the numbers that have such a file and at nothing else, so a run
that ends between two writes leaves nothing to be seen; the next run takes the same number and
overwrites what was left. Versions hold changed rows only: the newest row of a key counts. ``compact``
writes a version that holds every row, and readers begin at the last one of these.

The switch is a rename onto a name that must not exist, so of two writers one fails. A batch has a
name; a batch that is already visible is found by it and is not applied again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows of one file. Rows of a version are much alike, so a file of many rows is small and a scan would put all of them
#: into one task, which sorts them by key; Spark counts each file as 4 MB or more, so a task reads 32 files at most.
ROWS_PER_FILE = 50_000


class Version(NamedTuple):
    number: int
    batch: str
    full: bool


class VersionConflict(RuntimeError):
    """Another writer took the version."""


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marker(self, number: int) -> str:
        return f"{self.root}/_visible/{number:010d}.json"

    def versions(self) -> list[Version]:
        """Visible versions in order: one small file each."""
        folder = self._path(f"{self.root}/_visible")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        if not any(n.endswith(".json") for n in names):
            return []
        rows = self.spark.read.schema("number bigint, batch string, full boolean").json(f"{self.root}/_visible/*.json").collect()
        return sorted(Version(*r) for r in rows)

    def find(self, batch: str) -> int | None:
        """The version that a batch made, if it is visible."""
        return next((v.number for v in self.versions() if v.batch == batch), None)

    def _from_last_full(self) -> list[Version]:
        versions = self.versions()
        begin = max((i for i, v in enumerate(versions) if v.full), default=0)
        return versions[begin:]

    def rows(self, name: str, schema: str, numbers: Sequence[int] | None = None) -> DataFrame:
        """All visible rows of a table, with their ``version``; of all versions or of those given."""
        visible = [v.number for v in (self._from_last_full() if numbers is None else self.versions())]
        wanted = [n for n in visible if numbers is None or n in numbers]
        paths = [p for p in (f"{self.root}/{name}/version={n}" for n in wanted) if self._fs.exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("bigint"))
        read = self.spark.read.schema(f"{schema}, version bigint").option("basePath", f"{self.root}/{name}")
        return read.parquet(*paths)

    def newest(self, name: str, schema: str, keys: Sequence[str]) -> DataFrame:
        """The newest row of each key, with the ``version`` it is from."""
        rows = self.rows(name, schema)
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("row")).select(*keys, "row.*")

    def write(self, tables: dict[str, DataFrame], batch: str, full: bool = False) -> int:
        """Write the rows of all tables, then make them visible; returns the version."""
        done = self.find(batch)
        if done is not None:
            return done
        number = self.next_number()
        for name, rows in tables.items():
            rows.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.root}/{name}/version={number}")
        self._switch(Version(number, batch, full))
        return number

    def next_number(self) -> int:
        return max((v.number for v in self.versions()), default=0) + 1

    def _switch(self, version: Version) -> None:
        target = self._path(self._marker(version.number))
        trial = self._path(f"{self.root}/_visible/_{version.number:010d}.{abs(hash(version.batch))}.tmp")
        out = self._fs.create(trial, True)
        out.write(bytearray(json.dumps(version._asdict()).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(trial, target):
            raise VersionConflict(f"version {version.number} is taken")

    def compact(self, tables: dict[str, tuple[str, Sequence[str]]], batch: str) -> int:
        """Write the newest rows of ``tables`` (name: schema, keys) as one version that stands for all before it."""
        return self.write({n: self.newest(n, schema, keys).drop("version") for n, (schema, keys) in tables.items()}, batch, full=True)
