"""Small files that name versions, and tables that grow by batch under them.

``publish`` writes new versions of several tables and then one manifest that names them all, so readers see the old set
or the new one, never a mixture.  A ``Ledger`` keeps what batches add as a merged base and the batches since; a batch that
runs again replaces its own part, and merging changes nothing that is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_manifest(spark: SparkSession, folder: str, content: dict) -> int:
    """Add a manifest with the next number; it appears whole or not at all."""
    number = int(manifests(spark, folder)[-1][0]) + 1 if manifests(spark, folder) else 1
    fs, draft = _fs(spark, f"{folder}/_draft-{number:012d}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{folder}/{number:012d}.json")[1]):
        raise RuntimeError(f"manifest {number} of {folder} was written by another run")
    return number


def manifests(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Number and path of the manifests of a folder, oldest first."""
    return [(n.removesuffix(".json"), f"{folder}/{n}") for n in _names(spark, folder) if n.endswith(".json")]


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 3) -> int:
    """Write a version of each table below ``root`` and then the manifest that makes them current; returns its number.

    Tables that are not given stay as they are.  The versions that the last ``keep`` manifests name stay for readers that
    still hold them; older ones are deleted.
    """
    folder = f"{root}/_published"
    past = manifests(spark, folder)
    current = read_manifest(spark, past[-1][1]) if past else {}
    number = int(past[-1][0]) + 1 if past else 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={number:012d}")
    write_manifest(spark, folder, current | dict.fromkeys(tables, number))
    past = manifests(spark, folder)
    named = {(name, v) for _, path in past[-keep:] for name, v in read_manifest(spark, path).items()}
    for _, path in past[:-keep]:
        for name, v in read_manifest(spark, path).items():
            if (name, v) not in named:
                _delete(spark, f"{root}/{name}/version={v:012d}")
        _delete(spark, path)
    return number


def published(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame | None:
    """The current version of a table, or None before it was first published."""
    past = manifests(spark, f"{root}/_published")
    version = read_manifest(spark, past[-1][1]).get(name) if past else None
    if version is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{name}/version={version:012d}")


class Ledger:
    """A table that batches of one feed add to: ``base/version=V`` holds what was merged, ``open/batch=N`` the rest.

    ``merged`` turns the union of base and batches into the new base (the sums of counts, say), and must allow being
    applied to its own results.  With ``bucket``, a column of that name partitions base and batches, and readers name
    the buckets they need; other buckets are not read.
    """

    def __init__(self, root: str, schema: str, merged: Callable[[DataFrame], DataFrame], bucket: str | None = None):
        self.root, self.schema, self.merged, self.bucket = root, schema, merged, bucket

    def _write(self, df: DataFrame, path: str) -> None:
        if self.bucket:
            df.repartition(self.bucket).write.mode("overwrite").partitionBy(self.bucket).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def add(self, df: DataFrame, batch: int) -> None:
        """The rows of a batch; those of an earlier attempt are replaced.

        A batch that was merged cannot be run again: ``merge`` leaves the newest one open for that reason.
        """
        if batch <= self._base(df.sparkSession).get("upto", -1):
            raise ValueError(f"batch {batch} of {self.root} is merged already")
        self._write(df, f"{self.root}/open/batch={batch:012d}")

    def _base(self, spark: SparkSession) -> dict:
        past = manifests(spark, f"{self.root}/_base")
        return read_manifest(spark, past[-1][1]) if past else {}

    def _open(self, spark: SparkSession) -> list[int]:
        upto = self._base(spark).get("upto", -1)
        found = [int(n.removeprefix("batch=")) for n in _names(spark, f"{self.root}/open") if n.startswith("batch=")]
        return [n for n in found if n > upto and _fs(spark, f"{self.root}/open/batch={n:012d}/_SUCCESS")[0].exists(
            _fs(spark, f"{self.root}/open/batch={n:012d}/_SUCCESS")[1])]

    def read(self, spark: SparkSession, buckets: list | None = None, without: int | None = None) -> DataFrame:
        """Base and open batches, except batch ``without``; rows of several of them are not combined here."""
        base, schema = self._base(spark), StructType.fromDDL(self.schema)
        paths = [f"{self.root}/base/version={base['version']:012d}"] if base else []
        paths += [f"{self.root}/open/batch={n:012d}" for n in self._open(spark) if n != without]
        out = spark.createDataFrame([], schema)
        for path in paths:
            part = spark.read.schema(schema).parquet(path)
            out = out.unionByName(part if buckets is None else part.where(F.col(self.bucket).isin(buckets)))
        return out

    def merge(self, spark: SparkSession) -> bool:
        """Make a new base of all batches but the newest, which may be run again; was there something to merge?"""
        waiting = self._open(spark)[:-1]
        if not waiting:
            return False
        base = self._base(spark)
        version = base.get("version", 0) + 1
        whole = self.read(spark, without=max(self._open(spark)))
        self._write(self.merged(whole), f"{self.root}/base/version={version:012d}")
        write_manifest(spark, f"{self.root}/_base", {"version": version, "upto": waiting[-1]})
        for n in _names(spark, f"{self.root}/open"):  # nobody starts reading these any more
            if int(n.removeprefix("batch=")) <= base.get("upto", -1):
                _delete(spark, f"{self.root}/open/{n}")
        for n in _names(spark, f"{self.root}/base"):
            if int(n.removeprefix("version=")) < base.get("version", 0):
                _delete(spark, f"{self.root}/base/{n}")
        return True

    def clear(self, spark: SparkSession) -> None:
        _delete(spark, self.root)
