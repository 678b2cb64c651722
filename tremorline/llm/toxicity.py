"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.llm.common import query, small_batches, utf8

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NgramModel:
    """``weights`` of the chosen hash buckets (already times their log-count ratio); 0 features mean a constant score."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int


def _pieces(data: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _gram_buckets(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each order the bucket of the n-gram that starts at each position."""
    h = points.astype(np.uint64)
    for n in range(2, max(orders) + 1):
        h = h[:-1] * MIX + points[n - 1:]
        h ^= h >> np.uint64(29)
        if n in orders:
            yield ((h * MIX) >> np.uint64(64 - bits)).astype(np.int64), n


def _points(raw: bytes) -> np.ndarray:
    """Code points; A-Z and the capitals of Latin-1 lower-cased, white space and control characters as blanks."""
    c = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)), c + 32, c)
    return np.where(c < 33, 32, c).astype(np.uint64)


def counted(texts: pa.Array, orders: tuple[int, ...], bits: int, column: np.ndarray, width: int,
            limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows ``(first, last, keys, counts)``, keys sorted: ``(row - first) * width + column[bucket]``.

    Buckets whose column is negative are left out.  Each text stands between blanks.  A very long text is read in
    pieces that overlap by the length of an n-gram; only its counts are kept.
    """
    data, at = utf8(texts)
    longest = max(orders)
    pad = b" " * longest
    for i, j in _pieces(data, at, limit):
        if j - i == 1 and at[j] - at[i] > 2 * limit:
            text = (pad + data[at[i]:at[j]].tobytes() + pad).decode("utf-8", "replace")
            total = np.zeros(width, np.int64)
            for s in range(0, len(text), limit):
                for b, n in _gram_buckets(_points(text[s:s + limit + longest - 1].encode("utf-8")), orders, bits):
                    k = column[b[:limit]]
                    total += np.bincount(k[k >= 0], minlength=width)
            keys = np.flatnonzero(total)
            yield i, j, keys, total[keys]
            continue
        raw = b"".join(x for r in range(i, j) for x in (pad, data[at[r]:at[r + 1]].tobytes(), pad))
        points = _points(raw)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        ends = np.cumsum(lead)[np.cumsum(at[i + 1:j + 1] - at[i:j] + 2 * longest) - 1]
        found = []
        for b, n in _gram_buckets(points, orders, bits):
            k = column[b]
            hit = np.flatnonzero(k >= 0)
            own = np.searchsorted(ends, hit, "right")
            inside = hit + n <= ends[own]  # no n-gram reaches into the next text
            found.append(own[inside] * width + k[hit[inside]])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        yield i, j, keys, counts


def _ratios(training: DataFrame, orders: tuple[int, ...], bits: int, features: int) -> list:
    """The ``features`` buckets that separate the classes best, with their log-count ratios, from document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        docs, seen, column = np.zeros(2, np.int64), np.zeros((2, size), np.int64), np.arange(size)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for i, _, keys, _ in counted(batch.column(1), orders, bits, column, size):
                which = label[i + keys // size]
                for y in (0, 1):
                    seen[y] += np.bincount(keys[which == y] % size, minlength=size)
            docs += np.bincount(label, minlength=2)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], docs[0])),
                                          pa.array(np.append(seen[1, at], docs[1]))], ["bucket", "without", "with"])

    counts = (training.mapInArrow(count, "bucket long, without long, with long").groupBy("bucket")
              .agg(F.sum("without").alias("without"), F.sum("with").alias("with")))
    totals = counts.where("bucket = -1").first()
    if totals is None or not totals["without"] or not totals["with"]:
        return [totals, []]
    n, p = totals["without"], totals["with"]
    q_rate, p_rate = (F.col("without") + 1) / (n + 2), (F.col("with") + 1) / (p + 2)
    pooled = (F.col("without") + F.col("with") + 1) / (n + p + 2)
    gain = F.abs(p_rate - q_rate) / F.sqrt(pooled)
    chosen = (counts.where("bucket >= 0").select("bucket", F.log(p_rate / q_rate).alias("ratio"), gain.alias("gain"))
              .orderBy(F.desc("gain"), "bucket").limit(features))
    return [totals, chosen.collect()]


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float,
         steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on a sparse matrix in coordinates, by Adam on the whole bounded sample."""
    prior = y.mean()
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], len(y)) + b
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(cols, values * miss[rows], width) / len(y) + penalty * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          orders: tuple[int, ...] = (4, 5, 6), bits: int = 18, features: int = 2048, max_rows: int = 8000,
          penalty: float = 1e-3, steps: int = 200) -> NgramModel:
    """Fit on at most ``max_rows`` labelled rows (those of least hash of the id).

    Rows without id or label are not used; of several labels of an id the largest counts.  If a class has no row, the
    score is a constant: the share of label 1, or 0.5 without any row.
    """
    small_batches(docs.sparkSession)
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(label_col).cast("long").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    training = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(usable), "_id")
                .select("_y", "_text"))
    totals, chosen = _ratios(training, orders, bits, features)
    if not chosen:
        n, p = (totals["without"], totals["with"]) if totals else (0, 0)
        share = p / (n + p) if n + p else 0.5
        return NgramModel(np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))), orders, bits)
    buckets = np.array([r["bucket"] for r in chosen], np.int64)
    ratio, width = np.array([r["ratio"] for r in chosen]), len(chosen)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << bits, -1)
        column[buckets] = np.arange(width)
        for batch in batches:
            cols, counts = [None] * batch.num_rows, [None] * batch.num_rows
            for i, j, keys, n in counted(batch.column(1), orders, bits, column, width):
                at = np.searchsorted(keys, np.arange(j - i + 1) * width)
                for r, a, b in zip(range(i, j), at, at[1:]):
                    cols[r], counts[r] = keys[a:b] % width, n[a:b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32()))], ["y", "cols", "counts"])

    got = training.mapInArrow(extract, "y long, cols array<int>, counts array<int>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    lists = [got.column(c).combine_chunks() for c in ("cols", "counts")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    cols, counts = (x.flatten().to_numpy() for x in lists)
    rows = np.repeat(np.arange(len(y)), lists[0].value_lengths().to_numpy())
    w, b = _fit(rows, cols, np.log1p(counts) * ratio[cols], y, width, penalty, steps)
    return NgramModel(buckets, w * ratio, b, orders, bits)


def scores(docs: DataFrame, model: NgramModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """Replace the text by a score from 0 to 1 (a column called ``name`` is replaced).

    Whole texts are read, long ones in pieces; a null text is scored like an empty one; null ids and equal rows stay and
    are scored alike; an empty table stays empty.  Other columns pass through.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, name)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(model.buckets))
        column = np.full(1 << model.bits, -1)
        column[model.buckets] = np.arange(len(model.buckets))
        weights = model.weights if len(model.buckets) else np.zeros(1)
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for i, j, keys, n in counted(batch.column(len(kept)), model.orders, model.bits, column, width):
                z[i:j] += np.bincount(keys // width, np.log1p(n) * weights[keys % width], j - i)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(score)], [*kept, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` double"])
    return docs.select(*kept, text_col).mapInArrow(work, schema)


def remainder(id_col: str, of: int) -> Column:
    """The fold of a row: CRC-32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(of))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(remainder("doc_id", 5) != 0), "toxic")
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
