"""Line dedup by a log-template tree: token count and leading tokens lead to a leaf, varying fields are generalised.

The tree has fixed depth: the number of tokens of a line, then its first tokens; a token that holds a digit is a
variable field everywhere.  A leaf holds many templates: every line as it is, every line with one more field
variable, and the one in which a field is constant if one token holds it in most lines of the leaf.  A template that
recurs in enough documents drops its lines; apart from whole lines it must be mostly constant behind the leading tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.llm.common import query, small_batches, utf8
from tremorline.llm.repeats import keyed
from tremorline.session import cut_lineage

DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"
FIELD_HASH = xxhash.xxh32_intdigest(FIELD)
FILTER_BITS = 22  # the filter of leaves has 4 million bits, whatever the corpus


def _tokens(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [FIELD if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def _leaf(tokens: list[bytes], depth: int) -> int:
    x = xxhash.xxh3_64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:depth]]))
    return x - (1 << 64) if x >> 63 else x


def _lines(data: np.ndarray, ends: np.ndarray, depth: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Row, number of the line, leaf and tokens of each line that is not blank."""
    for r, (a, b) in enumerate(zip(ends, ends[1:])):
        for k, line in enumerate(data[a:b].tobytes().split(b"\n")):
            if tokens := _tokens(line):
                yield r, k, _leaf(tokens, depth), tokens


def _keys(tokens: list[bytes], depth: int, similarity: float) -> list[int]:
    """Keys of the line as it is, and with each one field behind the leading ones variable, if mostly constant then.

    A key is a sum of hashes of tokens and their places, so a long line costs no more per token.
    """
    digest, wrap = xxhash.xxh3_64_intdigest, (1 << 64) - 1
    parts = [digest(t, j) for j, t in enumerate(tokens)]
    whole, constant = sum(parts), sum(t != FIELD for t in tokens[depth:])
    out = [whole & wrap] if constant or any(t != FIELD for t in tokens[:depth]) else []
    if constant > 1 and constant - 1 >= similarity * (len(tokens) - depth):
        out += [whole - parts[j] + digest(FIELD, j) & wrap for j in range(depth, len(tokens)) if tokens[j] != FIELD]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _key_counts(depth: int, similarity: float, leaf_words: dict[int, int]):
    """``key, n``: the documents with each key, of lines whose leaf passes the filter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(0))
            out, last, seen = [], -1, set()
            for r, _, leaf, tokens in _lines(data, ends, depth):
                if not _passes(leaf, leaf_words):
                    continue
                if r != last:
                    out += seen
                    last, seen = r, set()
                seen.update(_keys(tokens, depth, similarity))
            keys, n = np.unique(np.array(out + list(seen), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return work


def _key_places(depth: int, similarity: float, leaf_words: dict[int, int], key_words: dict[int, int]):
    """``key, id, tie, line`` for the keys that pass the filter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(2))
            row, line, key = [], [], []
            for r, k, leaf, tokens in _lines(data, ends, depth):
                if _passes(leaf, leaf_words):
                    for x in _keys(tokens, depth, similarity):
                        if _passes(x, key_words):
                            row.append(r)
                            line.append(k)
                            key.append(x)
            at = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]),
                 pa.array(line, pa.int32())], ["key", "id", "tie", "line"])

    return work


def _passes(x: int, words: dict[int, int]) -> int:
    bit = x & (1 << FILTER_BITS) - 1
    return words.get(bit >> 6, 0) >> (bit & 63) & 1


def _filter(keys: DataFrame, name: str) -> dict[int, int]:
    """The last bits of a column of longs as a bit set, by words of 64 bits."""
    bit = F.col(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = (keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(({name} & 63) as int))").alias("flag"))
            .groupBy("word").agg(F.bit_or("flag").alias("flags")).collect())  # at most 2 ** 16 rows
    return {r["word"]: r["flags"] & (1 << 64) - 1 for r in bits}


def _places(depth: int):
    """The leaf of every line: ``leaf, id, tie, line``; and once per document and leaf a count of 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(2))
            row, line, leaf, first = [], [], [], []
            last, seen = -1, set()
            for r, k, x, _ in _lines(data, ends, depth):
                if r != last:
                    last, seen = r, set()
                row.append(r)
                line.append(k)
                leaf.append(x)
                first.append(x not in seen)
                seen.add(x)
            at = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]),
                 pa.array(line, pa.int32()), pa.array(np.array(first, np.int64))], ["leaf", "id", "tie", "line", "docs"])

    return work


def _field_counts(depth: int, filter_words: dict[int, int]):
    """``leaf, field, token, n`` for lines whose leaf passes the filter; a line counts once per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh32_intdigest
        for batch in batches:
            data, ends = utf8(batch.column(0))
            out, last, seen = [], -1, set()
            for r, _, leaf, tokens in _lines(data, ends, depth):
                if not _passes(leaf, filter_words):
                    continue
                if r != last:
                    last, seen = r, set()
                line = b" ".join(tokens)
                if line in seen:
                    continue
                seen.add(line)
                out += [(leaf, j, digest(t)) for j, t in enumerate(tokens)]
            if not out:
                continue
            table = pa.table([pa.array(x, pa.int64()) for x in zip(*out)], ["leaf", "field", "token"])
            counts = table.group_by(["leaf", "field", "token"]).aggregate([([], "count_all")]).rename_columns(
                ["leaf", "field", "token", "n"]).combine_chunks()
            yield from counts.to_batches()

    return work


def _cut(depth: int, agree: float):
    """Texts without the lines that are named without a template, or match theirs behind the leading tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh32_intdigest
        for batch in batches:
            data, ends = utf8(batch.column(1))
            texts, n_lines, dropped = [], [], []
            for r, wanted in enumerate(batch.column(2).to_pylist()):
                lines = data[ends[r]:ends[r + 1]].tobytes().split(b"\n")
                gone = []
                for w in wanted or ():
                    if w["template"] is None:
                        gone.append(w["line"])
                        continue
                    tokens = _tokens(lines[w["line"]])
                    fixed = [(t, x) for t, x in list(zip(tokens, w["template"]))[depth:] if x >= 0]
                    if sum(digest(t) == x for t, x in fixed) >= agree * len(fixed):
                        gone.append(w["line"])
                out = set(gone)
                texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in out).decode("utf-8", "surrogatepass"))
                n_lines.append(sum(1 for x in lines if x.strip()))
                dropped.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                                              pa.array(dropped, pa.list_(pa.int64()))], ["id", "text", "n_lines", "dropped"])

    return work


def recurring_templates(docs: DataFrame, depth: int = 3, min_docs: int = 10, constant: float = 0.5,
                        similarity: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``id, tie, text``: the places ``leaf, id, tie, line`` of all lines, ``leaf, template`` of recurring leaves,
    and the places ``id, tie, line`` of lines that recur as they are or with one more variable field.

    A template lists per field the hash of its constant token, or -1 for a variable one.  It recurs if at least
    ``similarity`` of its fields behind the leading ones are constant and each constant token was seen in ``min_docs``
    documents or more.  A line of variable fields only is no template.

    Null and empty texts have no lines; lines without tokens are no template; equal rows are documents of their own, told
    apart by ``tie``; whole texts are read; an empty table gives three empty tables.  Other columns are ignored.
    """
    places = cut_lineage(docs.select("id", "tie", "text").mapInArrow(
        _places(depth), "leaf long, id long, tie long, line int, docs long"))
    often = cut_lineage(places.groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
    leaf_words = _filter(often, "leaf")
    keys = cut_lineage(docs.select("text").mapInArrow(_key_counts(depth, similarity, leaf_words), "key long, n long")
                       .groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("key"))
    sure = (docs.select("id", "tie", "text")
            .mapInArrow(_key_places(depth, similarity, leaf_words, _filter(keys, "key")), "key long, id long, tie long, line int")
            .join(keys, "key", "left_semi").select("id", "tie", "line"))
    counts = (docs.select("text").mapInArrow(_field_counts(depth, leaf_words), "leaf long, field long, token long, n long")
              .groupBy("leaf", "field", "token").agg(F.sum("n").alias("n")))
    fields = (counts.groupBy("leaf", "field").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("lines"))
              .withColumn("fixed", (F.col("top.n") > constant * F.col("lines")) & (F.col("top.token") != FIELD_HASH)))
    templates = (fields.groupBy("leaf").agg(
        F.avg(F.when(F.col("field") >= depth, F.col("fixed").cast("double"))).alias("share"),
        F.min(F.when(F.col("fixed"), F.col("top.n"))).alias("support"),
        F.array_sort(F.collect_list(F.struct("field", F.when(F.col("fixed"), F.col("top.token")).otherwise(-1).alias("token")))).alias("f"))
        .where((F.col("share") >= similarity) & (F.col("support") >= min_docs))
        .join(often, "leaf", "left_semi").select("leaf", F.col("f.token").alias("template")))
    return places, cut_lineage(templates), sure  # written, so that a join may split a leaf with very many lines


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = 10,
                         constant: float = 0.5, similarity: float = 0.6, agree: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id, ``text`` without recurring lines, ``n_lines`` (not blank) and ``dropped`` numbers.

    A line goes if it recurs in ``min_docs`` documents as it is (tokens with digits apart), or with one more variable field,
    or if behind the leading tokens it agrees with at least ``agree`` of the constant fields of its leaf's template.  Lines
    end at line breaks; blank lines stay.  Every row counts as a document, repeated rows too; null ids are an id; null
    texts are empty; an empty table gives an empty table; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    places, templates, sure = recurring_templates(own, depth, min_docs, constant, similarity)
    by_leaf = places.join(templates, "leaf").select("id", "tie", "line", "template")
    named = sure.withColumn("template", F.lit(None).cast("array<long>")).unionByName(by_leaf)
    wanted = (named.groupBy("id", "tie", "line").agg(F.min("template").alias("template"), F.count("template").alias("n"), F.count("*").alias("all"))
              .select("id", "tie", "line", F.when(F.col("n") == F.col("all"), F.col("template")).alias("template"))
              .groupBy("id", "tie").agg(F.collect_list(F.struct("line", "template")).alias("wanted")))
    return (own.join(wanted, ["id", "tie"], "left").select("doc", "text", "wanted")
            .mapInArrow(_cut(depth, agree), "id long, text string, n_lines long, dropped array<long>")
            .withColumnRenamed("id", id_col))


@query()
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                       F.sha2("text", 256).alias("kept_sha256"))
