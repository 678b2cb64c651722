"""Fill-in-middle: texts cut at two places, found by a Fenwick tree over fixed blocks of the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.llm.common import query, small_batches, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = re.compile(rb"<[PSM]>")


class BlockTree:
    """A Fenwick tree over blocks of ``size`` bytes: how many units, and how many code points, start in them."""

    def __init__(self, text: np.ndarray, units: np.ndarray, size: int = 1024):
        """``text``: UTF-8 bytes; ``units``: at each byte whether a unit starts there."""
        self.units, self.leads, self.size = units, (text & 0xC0) != 0x80, size
        starts = np.arange(0, len(text), size)
        self.blocks = len(starts)
        self.trees = []
        for marks in (self.units, self.leads):
            tree = [0, *(np.add.reduceat(marks, starts, dtype=np.int64).tolist() if self.blocks else ())]
            for i in range(1, self.blocks + 1):
                if (j := i + (i & -i)) <= self.blocks:
                    tree[j] += tree[i]
            self.trees.append(tree)
        self.n = self._total(0)

    def _total(self, which: int) -> int:
        total, i = 0, self.blocks
        while i:
            total += self.trees[which][i]
            i -= i & -i
        return total

    def cut_after(self, k: int) -> tuple[int, int]:
        """Where the first ``k`` units end: offset in bytes, and number of code points before it."""
        if k >= self.n:
            return len(self.units), self._total(1)
        if k <= 0:
            return 0, 0
        units, points = self.trees
        block, before = 0, 0
        left, step = k, 1 << self.blocks.bit_length()
        while step:  # the last block that at most k units precede holds the start of the unit after the cut
            if (to := block + step) <= self.blocks and units[to] <= left:
                block, left, before = to, left - units[to], before + points[to]
            step >>= 1
        a = block * self.size
        at = int(np.flatnonzero(self.units[a:a + self.size])[left])
        return a + at, before + int(np.count_nonzero(self.leads[a:a + at]))


def unit_starts(text: np.ndarray, unit: str | None = None) -> np.ndarray:
    """At each byte whether a unit starts there; units are code points, or the matches of ``unit`` from left to right.

    What lies between two matches belongs to the one before; what lies before the first is a unit of its own.
    """
    if unit is None:
        return (text & 0xC0) != 0x80
    starts = np.zeros(len(text), bool)
    if len(text):
        starts[0] = True
        words = text.tobytes().decode("utf-8", "surrogateescape")
        at = np.flatnonzero((text & 0xC0) != 0x80)
        starts[at[[m.start() for m in re.finditer(unit, words) if m.end() > m.start()]]] = True
    return starts


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2^32 from SHA-256 of ``seed:key``; a null key is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: bytes, key: object, seed: int, plain_from: int, spm_below: int, unit: str | None = None,
               block: int = 1024) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain), and the output."""
    data = np.frombuffer(text, np.uint8)
    tree = BlockTree(data, unit_starts(data, unit), block)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= plain_from or SENTINEL.search(text):
        return tree.n, "plain", None, None, text
    low, high = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (a, prefix), (b, both) = tree.cut_after(low), tree.cut_after(high)
    if h4 % 100 < spm_below:
        return tree.n, "spm", prefix, both - prefix, SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b]
    return tree.n, "psm", prefix, both - prefix, PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90,
                   spm_below: int = 20, unit: str | None = None, block: int = 1024) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output``: each text rearranged so that a model learns to fill gaps.

    Four hashes of seed and id choose cuts and form: ``plain`` (the text as it is) in ``100 - plain_from`` of 100 cases,
    else ``spm`` (suffix, prefix, middle) in ``spm_below`` of 100, else ``psm``.  Cuts fall between units: code points,
    or matches of the pattern ``unit``.  A Fenwick tree over blocks of ``block`` bytes gives the block of a cut in
    logarithmic time; the boundary is then sought in that block alone.

    Null texts are empty; empty texts and texts that hold a sentinel are plain, with null lengths.  A null id draws as
    the empty text.  Every row gives one row, so repeats stay, and rows of one id are cut by the same draws.  Long texts
    cost time and memory in proportion.  Other columns are ignored, so their names cannot clash.
    """
    small_batches(docs.sparkSession, 500)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            made = [rearranged(data[a:b].tobytes(), key, seed, plain_from, spm_below, unit, block)
                    for key, a, b in zip(batch.column(0).to_pylist(), at, at[1:])]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(work, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
                          ).withColumnRenamed("_id", id_col)


def restored(form, output):
    """The text from form and output; sentinels cannot be part of a rearranged text, so splitting at them is exact."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
h AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(text) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(text) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (
  SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars,
       CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


@query(SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
