"""Shared helpers: small Arrow batches, raw UTF-8 access, a registry for the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register ``(spark, sf_dir) -> DataFrame``, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds: ``rows`` whole texts at a time instead of the default 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without copying, and the n + 1 offsets of its values (null: empty)."""
    n, at = len(texts), texts.offset
    _, ends, data = texts.buffers()
    if n == 0 or ends is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(ends, kind)[at:at + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def with_columns(batch: pa.RecordBatch, drop: str, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without the column ``drop`` and with the columns ``new``."""
    keep = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != drop}
    return pa.RecordBatch.from_arrays([*keep.values(), *new.values()], [*keep, *new])


def consecutive(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys from rows that arrive sorted by ``keys``: tables and the start of each run in them.

    Only the run that may continue in the next batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        if held:
            new[0] = any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        last = np.flatnonzero(new)
        if not len(last):
            held.append(batch)
            continue
        cut = int(last[-1])
        done = pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
        held = [batch.slice(cut)]
        if done.num_rows:
            yield done.combine_chunks(), _starts(done, keys)
    if held:
        done = pa.Table.from_batches(held)
        yield done.combine_chunks(), _starts(done, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
