"""Document fingerprints by content-defined chunking: gear-hash boundaries, chunk digests, containment by length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tremorline.llm.common import query, small_batches, utf8

#: Smallest, normal and largest chunk in bytes, bits of the boundary test at the normal size, bytes the hash looks back.
LEAST, NORMAL, MOST, BITS, LOOK_BACK = 4, 16, 64, 4, 16


def _gear_table() -> np.ndarray:
    """A 32-bit value per byte, drawn from a hash of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


GEAR = _gear_table()


def _gear(b: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last ``LOOK_BACK`` bytes: sums of table values, each shifted once per byte since."""
    h, k = GEAR[b], 1
    while k < LOOK_BACK:
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h, k = longer, 2 * k
    return h


def boundaries(data: np.ndarray, piece: int = 1 << 20) -> list[int]:
    """Ends of the chunks of a text.

    Normalised: below the normal size a boundary must pass a test with one bit more, above it with one bit less.  The
    hash depends on the last bytes alone, so after an edit boundaries fall into step again.
    """
    hard, easy = [], []
    bit = lambda n: np.uint32(((1 << n) - 1) << (LOOK_BACK - n))  # noqa: E731  the highest bits see the whole look-back
    for s in range(0, len(data), piece):
        lead = min(s, LOOK_BACK)
        h = _gear(data[s - lead:s + piece])[lead:]
        loose = np.flatnonzero((h & bit(BITS - 1)) == 0)
        hard.append(loose[(h[loose] & bit(BITS + 1)) == 0] + s + 1)
        easy.append(loose + s + 1)
    hard, easy = (np.concatenate(x).tolist() if x else [] for x in (hard, easy))
    hard.append(len(data) + MOST)
    easy.append(len(data) + MOST)
    ends, c, i, j, n = [], 0, 0, 0, len(data)
    while n - c > LEAST:
        while hard[i] < c + LEAST:
            i += 1
        if hard[i] < c + NORMAL:
            c = hard[i]
        else:
            while easy[j] < c + NORMAL:
                j += 1
            c = min(easy[j], c + MOST, n)
        c = min(c, n)
        ends.append(c)
    if c < n:
        ends.append(n)
    return ends


def chunk_set(text: bytes) -> dict[int, int]:
    """Digest to length of the different chunks of a text."""
    digest, out, a = xxhash.xxh32_intdigest, {}, 0
    for e in boundaries(np.frombuffer(text, np.uint8)):
        out[digest(text[a:e])] = e - a
        a = e
    return out


def written(chunks: dict[int, int]) -> str:
    """The set as text: 8 hex digits of digest and 2 of length each, in order of digest."""
    if not chunks:
        return ""
    keys = np.fromiter(chunks, np.uint32, len(chunks))
    order = np.argsort(keys)
    both = np.empty((len(keys), 5), np.uint8)
    both[:, :4] = keys[order].astype(">u4").view(np.uint8).reshape(-1, 4)
    both[:, 4] = np.fromiter(chunks.values(), np.uint8, len(chunks))[order]
    return both.tobytes().hex()


def read(fingerprint: str) -> dict[int, int]:
    both = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return dict(zip(both[:, :4].copy().view(">u4").ravel().tolist(), both[:, 4].tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of the chunks of ``a``, by length, that ``b`` has; of two empty sets 1, of one empty set 0."""
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum(n for k, n in a.items() if k in b) / whole


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Replace the text by its fingerprint (a column called ``name`` is replaced); null and empty texts: ''."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, name)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(len(kept)))
            prints = [written(chunk_set(data[a:b].tobytes())) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(prints, pa.string())],
                                             [*kept, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` string"])
    return docs.select(*kept, text_col).mapInArrow(work, schema)


def with_next(docs: DataFrame, id_col: str, rows_per_part: int = 2000, most_parts: int = 200_000,
              splits: int = 256) -> tuple[DataFrame, list[str]]:
    """``docs`` in parts of consecutive ids, and after the rows of each part the first row of the following one.

    Adds ``_part`` (0 holds the highest ids), ``_guest`` and ``_id``.  Sorted by part, guest last, id descending, rows
    have their successor next to them; after the last part comes the very first row again.  Ids are cut at ``splits``
    approximate quantiles and evenly between them, so there are never more than about ``most_parts`` parts; uneven ids
    make parts uneven, nothing else.  A null id is the lowest.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("_id"))
    n, low, high = ids.agg(F.count("*"), F.min("_id"), F.max("_id")).first()
    parts = min(max(1, n // rows_per_part), most_parts)
    splits = min(splits, parts)
    cuts = ids.agg(F.percentile_approx("_id", [i / splits for i in range(1, splits)], 10_000)).first()[0] if splits > 1 else []
    bounds = sorted({low, *cuts, high}) if n else [0, 0]
    each = -(-parts // splits)

    def split_of(lo: int, hi: int):
        """Nested conditions of logarithmic depth: the first bound that is not below the id."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_id") <= F.lit(bounds[mid]), split_of(lo, mid)).otherwise(split_of(mid + 1, hi))

    upper = F.array(*[F.lit(float(x)) for x in bounds])
    top = upper[F.col("_split")]
    width = F.greatest(top - upper[F.greatest(F.col("_split") - 1, F.lit(0))], F.lit(1.0))
    inside = F.least(F.floor((top - F.col("_id").cast("double")) / width * each), F.lit(each - 1))
    placed = (docs.withColumn("_id", key).withColumn("_split", split_of(0, len(bounds) - 1))
              .withColumn("_part", (F.lit(len(bounds)) - F.col("_split")).cast("long") * each + inside).drop("_split"))
    firsts = placed.groupBy("_part").agg(F.max("_id").alias("_id"))  # one row per part
    before = F.lag("_part").over(Window.orderBy("_part"))
    last = F.max("_part").over(Window.partitionBy())
    guests = (placed.join(F.broadcast(firsts.select("_id", "_part", F.coalesce(before, last).alias("_host"))), ["_id", "_part"])
              .withColumn("_part", F.col("_host")).drop("_host").withColumn("_guest", F.lit(1)))
    return placed.withColumn("_guest", F.lit(0)).unionByName(guests), ["_part", "_guest"]


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how much of the text's they and the next document's hold.

    The next document has the next lower id; after the lowest comes the highest.  Edited: the last third (rounded down)
    of the code points gives way to the first as many of the next text.  Rows with equal ids follow each other in order
    of their text; a null id is the lowest; null texts are empty; a single row is its own successor; an empty table
    gives an empty table.  Other columns are ignored.  Texts move once, in parts of neighbouring ids.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts, keys = with_next(slim, "_doc")
    ordered = parts.select(*keys, "_id", "_doc", "_text").repartition("_part").sortWithinPartitions(
        "_part", "_guest", F.desc("_id"), "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            part, guest, doc, texts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for p, g, d, t in zip(part, guest, doc, texts):
                raw = t.encode("utf-8", "surrogatepass")
                here = (p, g, d, t, chunk_set(raw))
                if before is not None and before[0] == p and not before[1]:
                    rows.append(compare(before, here))
                before = here
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], NAMES)

    return ordered.mapInArrow(work, SCHEMA).withColumnRenamed("id", id_col)


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare(one: tuple, following: tuple) -> tuple:
    _, _, doc, text, chunks = one
    cut = len(text) // 3
    edited = (text[:len(text) - cut] + following[3][:cut]).encode("utf-8", "surrogatepass")
    edited_chunks = chunk_set(edited)
    return (doc, len(text), hashlib.sha256(edited).hexdigest(), written(chunks), written(edited_chunks),
            containment(chunks, edited_chunks), containment(chunks, following[4]))


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
