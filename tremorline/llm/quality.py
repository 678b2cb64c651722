"""Quality: a regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.llm.common import query, small_batches, utf8
from tremorline.llm.toxicity import remainder

#: Classes of bytes whose shares are features; every byte over 127 counts as a letter.
CLASSES = ("upper", "lower", "digit", "space", "line", "sentence", "symbol")
STATISTICS = (*CLASSES, "words", "word_length", "distinct", "repeated", "commonest", "marked", "line_length", "line_copies")


def _byte_classes() -> np.ndarray:
    kind = np.full(256, CLASSES.index("symbol"))
    for c in range(256):
        ch = chr(c)
        if c > 127 or ch.islower():
            kind[c] = CLASSES.index("lower")
        elif ch.isupper():
            kind[c] = CLASSES.index("upper")
        elif ch.isdigit():
            kind[c] = CLASSES.index("digit")
        elif ch == "\n":
            kind[c] = CLASSES.index("line")
        elif ch in " \t\r":
            kind[c] = CLASSES.index("space")
        elif ch in ".,;:?'\"-":
            kind[c] = CLASSES.index("sentence")
    return kind


KIND = _byte_classes()


def statistics(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Transformed statistics of one text: smoothed log-odds of shares, logarithms of sizes.

    Counts are gathered in pieces; of a long text only its different words and lines are held.
    """
    bytes_of = np.zeros(len(CLASSES))
    words, lines, adjacent = Counter(), Counter(), 0
    at, last, open_line = 0, None, b""
    while at < len(text):
        cut = text.find(b" ", at + piece)
        part = text[at:cut if cut >= 0 else len(text)]
        at += max(len(part), 1)
        bytes_of += np.bincount(KIND[np.frombuffer(part, np.uint8)], minlength=len(CLASSES))
        tokens = part.split()
        words.update(tokens)
        adjacent += sum(map(bytes.__eq__, tokens, [last, *tokens]) if last is not None else map(bytes.__eq__, tokens[1:], tokens))
        last = tokens[-1] if tokens else last
        pieces = (open_line + part).split(b"\n")
        open_line = pieces.pop()
        lines.update(hash(x) for x in pieces if x)
    if open_line:
        lines[hash(open_line)] += 1
    n, total = len(text), sum(words.values())
    letters = sum(len(w) * k for w, k in words.items())
    marked = sum(k for w, k in words.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:?'\"-" and w[-2:-1] not in b"!*$%&#"))

    def odds(k: float, of: float) -> float:
        return float(np.log((k + 0.5) / (of - k + 0.5)))

    n_lines = sum(lines.values())
    return np.array([*(odds(k, n) for k in bytes_of), np.log1p(total), np.log1p(letters / max(total, 1)),
                     odds(len(words), total), odds(adjacent, max(total - 1, 0)),
                     odds(max(words.values(), default=0), total), odds(marked, total),
                     np.log1p(n / max(n_lines, 1)), odds(n_lines - len(lines), n_lines)])


def _all_statistics(texts: pa.Array) -> np.ndarray:
    data, at = utf8(texts)
    return np.array([statistics(data[a:b].tobytes()) for a, b in zip(at, at[1:])]).reshape(len(texts), len(STATISTICS))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the shrunk covariance and its log determinant.

    With ``classes`` empty the score is the constant ``share``.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        x = (x - self.centre) / self.scale
        density = []
        for prior, mean, factor, log_det in self.classes:
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(prior - 0.5 * (np.einsum("ij,ij->j", z, z) + log_det))
        gap = np.clip(density[1] - density[0], -700, 700)
        return np.round(1 / (1 + np.exp(-gap)), 9)  # equal texts score alike in batches of any shape


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          shrinkage: float = 0.1, ridge: float = 0.02, max_rows: int = 20_000) -> Discriminant:
    """Fit on at most ``max_rows`` labelled rows (those of least hash of the id).

    Class covariances are shrunk: ``(1 - shrinkage)`` of the own one, ``shrinkage`` of the pooled one, plus ``ridge``
    on the standardised diagonal.  Only sums of products leave the tasks.  Rows without id or label are not used; of
    several labels of an id the largest counts.  With fewer than two rows in a class the score is the share of label 1
    (0.5 without any row).
    """
    small_batches(docs.sparkSession)
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    training = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(usable), "_id")
                .select("_y", "_text"))
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _all_statistics(batch.column(1))
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                sums[k] += x[y == k].T @ x[y == k]
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], ["at", "value"])

    got = training.mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(2 * (d + 1) ** 2)
    for r in got:
        sums[r["at"]] = r["value"]
    sums = sums.reshape(2, d + 1, d + 1)
    n = sums[:, 0, 0]
    if n.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), (), float(n[1] / n.sum()) if n.sum() else 0.5)
    whole = sums.sum(0)
    centre = whole[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(whole)[1:] / n.sum() - centre ** 2, 1e-6))
    means = [(s[0, 1:] / k - centre) / scale for s, k in zip(sums, n)]
    covs = [(s[1:, 1:] / k - np.outer(s[0, 1:], s[0, 1:]) / k ** 2) / np.outer(scale, scale) for s, k in zip(sums, n)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    classes = []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * covs[k] + shrinkage * pooled + ridge * np.eye(d))
        classes.append((float(np.log(n[k] / n.sum())), means[k], factor, 2 * float(np.log(np.diag(factor)).sum())))
    return Discriminant(centre, scale, tuple(classes), float(n[1] / n.sum()))


def scores(docs: DataFrame, model: Discriminant, text_col: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """Add a score from 0 to 1 (a column called ``name`` is replaced), without the text unless ``keep_text``.

    Whole texts are read; a null text is scored like an empty one; repeated rows stay; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name and (keep_text or c != text_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_all_statistics(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(score)], [*kept, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` double"])
    return docs.select(*kept, F.col(text_col).alias("_scored")).mapInArrow(work, schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Discriminant:
    """The production model: labels of the training folds only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.where(remainder("doc_id", 4) != 2), "quality")


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, fitted(spark, docs, sf_dir)).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
