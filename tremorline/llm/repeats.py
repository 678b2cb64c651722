"""Suffix-array dedup without the array: suffixes are ordered only through the first ``window`` bytes, by radix passes.

Removing a byte needs to know whether a string of ``window`` bytes over it also starts earlier.  So suffixes need not
be sorted fully: a most-significant-digit radix sort that stops at depth ``window`` leaves equal suffixes in one group,
and those groups are exactly the repeated windows.  Passes, each dropping what is alone:

1. the digit that decides where a window goes is its least ``grain`` bytes by hash (a function of the window alone, so
   equal windows agree).  Neighbouring windows mostly share it and travel as one run of windows;
2. equal runs are settled at once: all but the earliest repeat;
3. within a digit the windows of different runs are sorted by digits of eight bytes up to depth ``window``, exactly.

A digit with very many different runs goes on as single windows, keyed by two 64-bit hashes of all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.llm.common import consecutive, query, small_batches, utf8
from tremorline.session import cut_lineage

RUNS = "digit long, run long, id long, tie long, place long"
NULL_ID = -(1 << 63)  # a null id sorts first


def _place(at, length, lead):
    """Start, number of windows and distance to the deciding bytes of a run, in one long that sorts by start."""
    return (at << 20) | (length << 10) | lead


def _parts(place):
    return place >> 20, (place >> 10) & 1023, place & 1023


def grain_of(window: int) -> int:
    return 1 << max(0, (window // 3).bit_length() - 1)


def _grain_hashes(data: np.ndarray, grain: int) -> np.ndarray:
    """A 64-bit hash of the ``grain`` bytes from each position; ``grain`` is a power of two."""
    power, wrap = 0xD6E8FEB86659FD93, (1 << 64) - 1
    h, m = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while m < grain:
        h = h[:-m] * np.uint64(power) + h[m:]
        power, m = power * power & wrap, 2 * m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_runs(data: np.ndarray, window: int, piece: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that share their deciding bytes: arrays of start, number of windows, lead and digit."""
    grain = grain_of(window)
    wide = window - grain + 1
    for s in range(0, len(data) - window + 1, piece):
        part = data[s:s + piece + window - 1]
        h = _grain_hashes(part, grain)
        n = len(h)
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)  # least hash, leftmost of equals
        blocks = np.append(key, np.full(-n % wide, (1 << 64) - 1, np.uint64)).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:n - wide + 1], ahead[wide - 1:n])
        start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        at = (least[start] & np.uint64((1 << 20) - 1)).astype(np.int64)
        yield start + s, np.diff(np.append(start, len(least))), at - start, h[at].view(np.int64)


def _later(*columns: np.ndarray) -> np.ndarray:
    """Of rows sorted by group and order: which differ in order from the first row of their group."""
    *groups, ids, ties, places = columns
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[1:] != g[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return ~new & ((ids != ids[first]) | (ties != ties[first]) | (places >> 20 != places[first] >> 20))


def _merged(ids, ties, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settled runs that follow each other in a document as one, up to 1,000 windows long."""
    if not len(ids):
        return ids, ties, places
    order = np.lexsort((places, ties, ids))
    ids, ties, places = ids[order], ties[order], places[order]
    out_i, out_t, out_p = [], [], []
    i = t = start = stop = None
    for a, b, p in zip(ids.tolist(), ties.tolist(), places.tolist()):
        at, n, _ = _parts(p)
        if (a, b) == (i, t) and at <= stop and at + n - start <= 1000:
            stop = max(stop, at + n)
            continue
        if i is not None:
            out_i.append(i), out_t.append(t), out_p.append(_place(start, stop - start, 0))
        i, t, start, stop = a, b, at, at + n
    out_i.append(i), out_t.append(t), out_p.append(_place(start, stop - start, 0))
    return np.array(out_i, np.int64), np.array(out_t, np.int64), np.array(out_p, np.int64)


def _runs_of(window: int):
    """Map side of the first two passes: runs of a batch, of equal ones the earliest only; ``run`` 0 marks settled ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, ends = utf8(batch.column(2))
            digit, run, row, place = [], [], [], []
            for r, (a, b) in enumerate(zip(ends, ends[1:])):
                text = data[a:b]
                raw = text.tobytes()
                for at, n, lead, d in window_runs(text, window):
                    digit.append(d)
                    row.append(np.full(len(d), r))
                    place.append(_place(at, n, lead))
                    run.append(np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) | 1 for x, y in
                                            zip(at.tolist(), (at + n + window - 1).tolist())), np.uint64, len(d)).view(np.int64))
            if not digit:
                continue
            digit, run, row, place = map(np.concatenate, (digit, run, row, place))
            order = np.lexsort((place, ties[row], ids[row], run, digit))
            digit, run, row, place = digit[order], run[order], row[order], place[order]
            again = _later(digit, run, ids[row], ties[row], place)
            i, t, p = _merged(ids[row[again]], ties[row[again]], place[again])
            keep = ~again
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                np.append(digit[keep], p * -7046029254386353131 ^ i), np.append(run[keep], np.zeros(len(p), np.int64)),
                np.append(ids[row[keep]], i), np.append(ties[row[keep]], t), np.append(place[keep], p))],
                ["digit", "run", "id", "tie", "place"])

    return work


def _to_compare(digit: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Of rows sorted by digit and run: the first row of each run whose digit has several runs."""
    new_digit = np.append(True, digit[1:] != digit[:-1])
    new_run = new_digit | np.append(True, run[1:] != run[:-1])
    opened = np.flatnonzero(new_digit)
    runs = np.add.reduceat(new_run.astype(int), opened)
    return new_run & np.repeat(runs > 1, np.diff(np.append(opened, len(digit))))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side of the second pass: settled runs (``digit`` null) and the runs to compare within a digit.

    Rows stream by; between batches at most the first row of the open digit and that of its open run are held.
    """
    names = ["digit", "run", "id", "tie", "place"]
    carried: list[np.ndarray] | None = None  # the first row of the open digit and the first of its open run
    told = False  # whether the first row of the open digit has been given out
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        done = columns[1] == 0
        passed = [c[done] for c in columns[2:]]
        columns = [c[~done] for c in columns]
        settled, compare = [passed], []
        if len(columns[0]):
            k = 0
            if carried is not None:
                columns = [np.concatenate([c, x]) for c, x in zip(carried, columns)]
                k = len(carried[0])
            again, several = _later(*columns), _to_compare(*columns[:2])
            again[:k] = False
            if k:
                if told or not several[0]:
                    several[0] = False
                several[1:k] = False
            settled.append([c[again] for c in columns[2:]])
            compare.append([c[several] for c in columns])
            last_digit = np.flatnonzero(columns[0] == columns[0][-1])[0]
            open_run = np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0]
            same = carried is not None and carried[0][0] == columns[0][-1]
            told = (told if same else False) or bool(several[last_digit])
            rows = sorted({int(last_digit), int(open_run)})
            carried = [c[rows] for c in columns]
        s = [np.concatenate(x) for x in zip(*settled)]
        c = [np.concatenate(x) for x in zip(*compare)] if compare else [np.empty(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.zeros(len(s[0]), np.int64), c[0]), mask=np.arange(len(s[0]) + len(c[0])) < len(s[0])),
             *(pa.array(np.append(a, b)) for a, b in zip(s, c[2:]))], ["digit", "id", "tie", "place"])


def _cut_out(window: int):
    """Bytes of the runs to compare; those of crowded digits as single windows, by two hashes of all their bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(2))
            out = []
            for r, wanted in enumerate(batch.column(3).to_pylist()):
                i, t = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                text = data[ends[r]:ends[r + 1]].tobytes()
                for w in wanted:
                    at, n, lead = _parts(w["place"])
                    if not w["crowded"]:
                        out.append((w["digit"], 0, i, t, w["place"], text[at:at + n + window - 1]))
                        continue
                    for x in range(at, at + n):
                        piece = text[x:x + window]
                        out.append((_signed(xxhash.xxh3_64_intdigest(piece)), _signed(xxhash.xxh64_intdigest(piece) | 1), i, t,
                                    _place(x, 1, 0), None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out))],
                    ["digit", "run", "id", "tie", "place", "piece"])

    return work


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def radix_repeats(buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> list[np.ndarray]:
    """Groups of windows of ``buffer`` with equal bytes and equal ``group``, by passes over digits of eight bytes.

    Returns, sorted by group, the windows that are not alone and the number of the group of each.
    """
    padded = np.append(buffer, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(len(buffer), np.uint64)
    for j in range(8):
        word |= padded[j:j + len(buffer)] << np.uint64(8 * (7 - j))
    size = min(8, window)
    cut = np.uint64(64 - 8 * size)
    alive = np.arange(len(starts))
    for depth in [-1, *range(0, window - size, size), window - size]:
        if not len(alive):
            break
        digit = (word[starts[alive] + depth] >> cut) if depth >= 0 else np.zeros(len(alive), np.uint64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(new) - 1
        kept = np.bincount(group)[group] > 1
        alive, group = alive[kept], group[kept]
    return [alive, group]


def _compare(window: int):
    """The last passes: within a digit, which windows start earlier elsewhere."""

    def narrow(table: pa.Table, opened: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, ties, places = (table.column(c).to_numpy() for c in ("id", "tie", "place"))
        pieces = table.column("piece").combine_chunks()
        pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
        buffer, ends = utf8(pieces)
        bucket = np.cumsum(np.isin(np.arange(len(ids)), opened)) - 1
        at, n, lead = _parts(places)
        row = np.repeat(np.arange(len(ids)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        alive, group = radix_repeats(buffer[ends[0]:ends[-1]], (ends[:-1] - ends[0])[row] + step,
                                     bucket[row] * 1024 + lead[row] - step, window)
        r, start = row[alive], at[row[alive]] + step[alive]
        order = np.lexsort((start, ties[r], ids[r], group))
        r, start, group = r[order], start[order], group[order]
        again = _later(group, ids[r], ties[r], start << 20)
        return ids[r[again]], ties[r[again]], _place(start[again], 1, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        done: list[tuple] = []

        def bytes_only():
            nonlocal tail
            for batch in batches:
                whole = batch.column("run").to_numpy() != 0
                if whole.any():
                    columns = [batch.column(c).to_numpy()[whole] for c in ("digit", "run", "id", "tie", "place")]
                    k = 0 if tail is None else 1
                    columns = [np.concatenate([a, b]) for a, b in zip(tail, columns)] if k else columns
                    again = _later(*columns)
                    done.append(tuple(c[again] for c in columns[2:]))
                    first = np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0]
                    tail = [c[first:first + 1] for c in columns]
                yield batch.filter(pa.array(~whole))

        def given(found: list[tuple]) -> pa.RecordBatch:
            i, t, p = _merged(*(np.concatenate(x) for x in zip(*found)))
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(p)], ["id", "tie", "place"])

        for table, opened in consecutive(bytes_only(), ["digit"]):
            done.append(narrow(table, opened))
            yield given(done)
            done.clear()
        if done:
            yield given(done)

    return work


def _finish(window: int):
    """Spans of a document from its settled windows, and the bytes outside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            kept, spans = [], []
            for r in range(batch.num_rows):
                text, places = data[ends[r]:ends[r + 1]].tobytes(), batch.column(2)[r].values
                own = []
                if places is not None and len(places):
                    at, n, _ = _parts(np.sort(places.to_numpy()))
                    stop = np.maximum.accumulate(at + n + window - 1)
                    new = np.flatnonzero(np.append(True, at[1:] > stop[:-1]))
                    own = list(zip(at[new].tolist(), stop[np.append(new[1:] - 1, len(at) - 1)].tolist()))
                edges = [0, *(x for s in own for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["id", "n_bytes", "kept", "spans"])

    return work


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tie, text, doc``: ``tie`` tells rows of one id apart (0 where no id is repeated, which is looked up first)."""
    slim = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    twice = slim.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    if twice.isEmpty():
        return slim.withColumn("tie", F.lit(0).cast("long"))
    marked = slim.join(twice.withColumn("twice", F.lit(True)), "id", "left")
    return marked.withColumn("tie", F.when(F.col("twice"), F.xxhash64("text")).otherwise(0)).drop("twice")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100,
                   crowd: int = 4000) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``kept`` (binary) and ``spans`` of removed bytes.

    A byte goes if a string of ``window`` bytes (at most 512) over it also starts earlier: in a document of lower id, or
    earlier in the same one.  Strings never cross documents and are judged on the input.  A null id is the lowest; rows
    of one id are documents in order of a hash of their text; rows equal in id and text are one document, listed as
    often, of which each gets the same result.  Null texts are empty; an empty table gives an empty table; other
    columns are ignored.  ``crowd``: digits with more different runs than this are compared window by window.
    """
    if not 2 <= window <= 512:
        raise ValueError("window must be from 2 to 512 bytes")
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    runs = own.select("id", "tie", "text").mapInArrow(_runs_of(window), RUNS)
    marked = cut_lineage(runs.repartition("digit").sortWithinPartitions("digit", "run", "id", "tie", "place")
                         .mapInArrow(_mark, "digit long, id long, tie long, place long"))
    compare = marked.where("digit is not null")
    # Written, so that the join below may split a digit with very many runs.
    crowds = cut_lineage(compare.groupBy("digit").agg((F.count("*") > crowd).alias("crowded")).where("crowded"))
    wanted = (compare.join(crowds, "digit", "left").groupBy("id", "tie")
              .agg(F.collect_list(F.struct("digit", "place", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted")))
    pieces = (own.select("id", "tie", "text").join(wanted, ["id", "tie"]).select("id", "tie", "text", "wanted")
              .mapInArrow(_cut_out(window), f"{RUNS}, piece binary"))
    found = (pieces.repartition("digit").sortWithinPartitions("digit", "run", "id", "tie", "place")
             .mapInArrow(_compare(window), "id long, tie long, place long"))
    settled = (marked.where("digit is null").select("id", "tie", "place").unionByName(found).groupBy("id", "tie")
               .agg(F.collect_list("place").alias("places")))
    return (own.join(settled, ["id", "tie"], "left").select("doc", "text", "places")
            .mapInArrow(_finish(window), "id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
            .withColumnRenamed("id", id_col))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS win
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT doc_id, s, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i),
p AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, k),
q AS (SELECT doc_id, list(a ORDER BY a) AS las, list(b ORDER BY a) AS lbs, count(*) AS n, sum(b - a) AS gone FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda x:
         substr(h, 2 * CASE WHEN x = 1 THEN 0 ELSE lbs[x - 1] END + 1,
                2 * (CASE WHEN x = n + 1 THEN len(h) // 2 ELSE las[x] END - CASE WHEN x = 1 THEN 0 ELSE lbs[x - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""


@query(SQL)
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
