"""Vocabulary as a table: phrases and words of any number meet texts in equi-joins.

The expression form in ``operators.classify`` holds the vocabulary in the plan, which suits some hundred entries.  Here a
phrase is found by one of its grams, a run of bytes of the largest size in ``GRAMS`` that the phrase has, chosen because
few other phrases share it.  Texts give the grams that a bitmap of the anchors (of fixed size) lets pass, by hash; those
meet phrases by equality, and only phrases met that way are looked for in the whole text.  So the work follows the text
and its near hits, not the vocabulary, and every phrase the expression form finds is found: a text that holds the phrase
holds all its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.text import token_set
from tremorline.operators.classify import DEFAULT_LEXICON, Lexicon, category_boost, concept_boost, decided
from tremorline.session import cut_lineage

#: Sizes of grams in bytes, slots of the bitmap as a power of two, bytes of text hashed at a time.
GRAMS = (32, 24, 20, 16, 14, 12, 10, 8, 6, 4, 2, 1)
SLOTS, PIECE = 26, 1 << 18
FACTOR = 0x9E3779B97F4A7C15
#: Entries rank as phrases, then words of the title, then words of the body, each in the order of its table.
WORDS, BODY_WORDS = 1 << 40, 1 << 41


def entries(spark: SparkSession, listed: list[tuple[str, str, float]]) -> DataFrame:
    """``at, word, kind, score`` of a list of (word, kind, score); ``at`` is the place in the list."""
    return spark.createDataFrame([(i, *e) for i, e in enumerate(listed)], "at long, word string, kind string, score double")


class _Hashes:
    """Hashes of all runs of given sizes in a piece of bytes, from one running sum."""

    def __init__(self, longest: int):
        import numpy as np

        up, down = np.full(longest + 1, FACTOR, np.uint64), np.full(longest + 1, pow(FACTOR, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def sums(self, data):
        import numpy as np

        return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)]))

    def runs(self, sums, size: int):
        import numpy as np

        h = (sums[size:] - sums[:-size]) * self.down[:len(sums) - size] + np.uint64(size)
        h ^= h >> np.uint64(31)
        return h * np.uint64(FACTOR)


def _slots(h):
    """Two places of the bitmap per hash."""
    import numpy as np

    return h >> np.uint64(64 - SLOTS), (h >> np.uint64(64 - 2 * SLOTS)) & np.uint64((1 << SLOTS) - 1)


def _bytes(column):
    """All bytes of a column of strings and where each begins; null counts as empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def _phrase_grams(batches: Iterator) -> Iterator:
    """``at, gram, one, two``: the different grams of each phrase and their slots; an empty phrase has none."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        at, grams = [], []
        for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer((word or "").encode(), np.uint8)
            if len(data):
                size = next(s for s in GRAMS if s <= len(data))
                hashes = _Hashes(len(data))
                grams.append(np.unique(hashes.runs(hashes.sums(data), size)))
                at += [key] * len(grams[-1])
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x.view(np.int64)) for x in (h, *_slots(h)))],
                                         ["at", "gram", "one", "two"])


def anchored(phrases: DataFrame) -> DataFrame:
    """``phrases`` (``at, word``) with ``gram``, the one of its grams that fewest phrases share, and its two slots."""
    keyed = cut_lineage(phrases.select("at", "word").mapInArrow(_phrase_grams, "at long, gram long, one long, two long"))
    shared = keyed.groupBy("gram").agg(F.count("*").alias("n"))
    return phrases.join(keyed.join(shared, "gram").groupBy("at").agg(
        F.min(F.struct("n", "gram", "one", "two")).alias("k")).select("at", "k.gram", "k.one", "k.two"), "at")


def _bitmap(keys: DataFrame):
    """The slots of all anchors as bits; its size is fixed whatever the vocabulary."""
    import numpy as np

    slot = keys.select(F.explode(F.array("one", "two")).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slot.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (SLOTS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _text_grams(bitmap):
    """``_row, gram`` of the grams of two texts that the bitmap lets pass."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits, hashes, longest = bitmap.value, _Hashes(PIECE + GRAMS[0]), GRAMS[0]

        def has(slot):
            return bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)

        for batch in batches:
            for column in batch.columns[1:]:
                data, at = _bytes(column)
                for start in range(int(at[0]), int(at[-1]), PIECE):
                    sums = hashes.sums(data[start:min(start + PIECE + longest - 1, int(at[-1]))])
                    rows, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                    for size in GRAMS:
                        if len(sums) > size:
                            h = hashes.runs(sums, size)[:PIECE]
                            one, two = _slots(h)
                            found = np.flatnonzero(has(one))
                            found = found[has(two[found]) == 1]
                            row = np.searchsorted(at, found + start, "right") - 1
                            whole = at[row + 1] >= found + start + size
                            rows.append(row[whole])
                            grams.append(h[found[whole]])
                    rows, grams = np.concatenate(rows), np.concatenate(grams).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(grams)], ["_row", "gram"])

    return work


def phrase_matches(texts: DataFrame, phrases: DataFrame, whole_words: bool = False) -> DataFrame:
    """``_row, front, at, kind, score``: phrases in a text's ``_front`` (``front`` true) or, failing that, its ``_behind``.

    ``texts``: ``_row`` (unique long), ``_front``, ``_behind``; ``phrases``: ``at, word, kind, score``.  Matching is literal.
    """
    spark = texts.sparkSession
    keys = cut_lineage(anchored(phrases))
    passed = texts.select("_row", "_front", "_behind").mapInArrow(
        _text_grams(spark.sparkContext.broadcast(_bitmap(keys))), "_row long, gram long")
    met = passed.distinct().join(keys.select("gram", "at"), "gram").select("_row", "at")
    near = (met.join(keys.select("at", "word", "kind", "score"), "at").groupBy("_row")
            .agg(F.collect_list(F.struct("at", "word", "kind", "score")).alias("met")))

    def holds(text: str) -> Column:
        if not whole_words:
            return F.col(text).contains(F.col("m.word"))
        literal = F.concat(F.lit("\\b\\Q"), F.replace(F.col("m.word"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
        return F.rlike(F.col(text), literal)

    found = texts.join(near, "_row").select("_row", "_front", "_behind", F.explode("met").alias("m"))
    return (found.withColumns({"front": holds("_front"), "behind": holds("_behind")}).where("front or behind")
            .select("_row", "front", "m.at", "m.kind", "m.score"))


def classify_by_table(df: DataFrame, phrases: DataFrame, words: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
                      min_score: float = C.MIN_SCORE, title: str = "title", body: str = "body", categories: str = "categories",
                      concepts: str = "concepts") -> DataFrame:
    """``operators.classify.classify`` with phrases and words from tables (``at, word, kind, score``; ``at`` unique).

    The other lists are those of ``lexicon``; its own phrases and words are not used.  Rows may repeat; every row of
    ``df`` gives one row.
    """
    keep = df.columns
    rows = cut_lineage(df.withColumns({
        "_row": F.monotonically_increasing_id(), "_cat": category_boost(F.col(categories), lexicon),
        "_con": concept_boost(F.col(concepts), lexicon), "_title_tokens": token_set(F.col(title))}))
    texts = rows.select("_row", F.lower(F.coalesce(F.col(title), F.lit(""))).alias("_front"),
                        F.lower(F.coalesce(F.col(body), F.lit(""))).alias("_behind"))
    weight = F.when(F.col("front"), F.col("score")).otherwise(F.col("score") * F.lit(C.BODY_PHRASE_WEIGHT))
    strict = F.col("front") & F.col("kind").isin(list(lexicon.needs_support))
    by_phrase = phrase_matches(texts, phrases, lexicon.whole_words).select(
        "_row", "kind", weight.alias("score"), (-F.col("at")).alias("order"), strict.alias("strict"))

    def by_word(tokens: DataFrame, factor: float, first: int) -> DataFrame:
        return tokens.join(words, "word").select("_row", "kind", (F.col("score") * F.lit(factor)).alias("score"),
                                                 (-(F.col("at") + first)).alias("order"), F.lit(False).alias("strict"))

    front = cut_lineage(by_phrase.unionByName(
        by_word(rows.select("_row", F.explode("_title_tokens").alias("word")), 1.0, WORDS)))
    bare = rows.where((F.col("_cat") > 0) | (F.col("_con") > 0)).join(front.select("_row").distinct(), "_row", "left_anti")
    behind = by_word(bare.select("_row", F.explode(token_set(F.col(body))).alias("word")), C.BODY_TOKEN_WEIGHT, BODY_WORDS)
    best = (front.unionByName(behind).groupBy("_row", "kind")
            .agg(F.max("score").alias("score"), F.max("order").alias("order"), F.bool_or("strict").alias("strict"))
            .groupBy("_row").agg(F.max(F.struct("score", "order", F.col("kind").alias("event_type"), "strict")).alias("_best")))
    return decided(rows.join(best, "_row", "left"), keep, lexicon, min_score, title, categories,
                   F.coalesce(F.col("_best.strict"), F.lit(False)))
