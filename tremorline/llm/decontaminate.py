"""Benchmark decontamination: a prefix-filtered set join between item windows and whole documents.

Every window of an item is found through its rarest word (its prefix token: exact containment needs no more than one);
the rarity of a word is its number of occurrences in all documents.  Neighbouring windows mostly share that word, so an
item is reduced to few anchors ``(word, position)``.  A document word that equals an anchor gives one candidate, whose
match is extended word by word to both sides; position and length bounds decide, and only exact runs remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tremorline.llm.common import query
from tremorline.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
END = "\n"  # no word contains it


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters, digits and all other characters; A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + NOT_WORD, UPPER.lower() + " " * len(NOT_WORD))
    return F.array_remove(F.split(plain, " +"), "")


def word_counts(docs: DataFrame, text_col: str, wanted: DataFrame, per_pass: int = 50_000) -> DataFrame:
    """Occurrences in all documents of the words in ``wanted`` (column ``word``, distinct), counted before any shuffle."""
    tokens = docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
    return _over_passes(wanted, per_pass,
                        lambda part: tokens.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("seen")))


def _over_passes(small: DataFrame, per_pass: int, job) -> DataFrame:
    """``job`` over ``small`` whole if it has at most ``per_pass`` rows, else over blocks of about that many, in union."""
    passes = -(-max(1, small.count()) // per_pass)
    if passes == 1:
        return job(small)
    blocks = [job(small.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i)) for i in range(passes)]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def anchors(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
            window: int = 10) -> DataFrame:
    """The rarest word of every window of every item: ``word, item, before, after, need``.

    ``before`` and ``after`` hold up to ``window - 1`` neighbours, nearest first; ``need`` is the length of the window.
    """
    listed = cut_lineage(
        items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                     words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
        .distinct().withColumn("row", F.monotonically_increasing_id()))
    placed = listed.select("row", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    wanted = cut_lineage(placed.select("word").distinct())
    rarity = word_counts(docs, text_col, wanted)
    first = F.greatest(F.lit(0), F.col("pos") - (window - 1))
    last = F.least(F.col("pos"), F.greatest(F.col("n") - window, F.lit(0)))
    chosen = (placed.join(rarity, "word", "left")
              .withColumn("start", F.explode(F.sequence(first, last)))
              .groupBy("row", "start")
              .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "pos")).alias("best"))
              .select("row", "best.pos").distinct())
    words, pos = F.col("words"), F.col("pos")
    return chosen.join(listed, "row").select(
        F.element_at(words, pos + 1).alias("word"), "item",
        F.reverse(F.slice(words, F.greatest(pos - (window - 2), F.lit(1)), F.least(pos, F.lit(window - 1)))).alias("before"),
        F.slice(words, pos + 2, window - 1).alias("after"),
        F.least(F.lit(window), F.size(words)).alias("need")).distinct()


def _matched(theirs: Column, ours: Column) -> Column:
    """How many leading elements agree."""
    differs = F.array_position(F.zip_with(theirs, ours, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs == 0, F.size(theirs)).otherwise(differs - 1).cast("int")


def contaminated_words(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", window: int = 10, per_pass: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``hits``.

    ``hits`` lists the runs ``(start, stop, item)`` of document words inside an occurrence of an item window, as found
    (runs may overlap).  Items of fewer than ``window`` words are one window; items and documents without words hit
    nothing.  A null item id counts as the item ''.  Null ids and repeated rows of ``docs`` keep a row each; further
    columns are ignored.  Anchors are broadcast ``per_pass`` at a time, whatever their number; texts never move.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = cut_lineage(anchors(docs.select(F.col("_text").alias(text_col)), items, text_col, item_col, window))
    mark = docs.sparkSession.range(1).select(
        F.lit(END).alias("word"), F.lit(None).cast("string").alias("item"), F.array().cast("array<string>").alias("before"),
        F.array().cast("array<string>").alias("after"), F.lit(0).alias("need"))
    tokens = (docs.select(F.monotonically_increasing_id().alias("_row"), "_id", words_of(F.col("_text")).alias("_words"))
              .select("_row", "_id", "_words", F.posexplode(F.concat("_words", F.array(F.lit(END)))).alias("_pos", "word")))
    words, pos = F.col("_words"), F.col("_pos")
    left = F.reverse(F.slice(words, F.greatest(pos - (window - 2), F.lit(1)), F.least(pos, F.lit(window - 1))))
    right = F.slice(words, pos + 2, window - 1)

    def runs(part: DataFrame) -> DataFrame:
        # Slices stay in generated code; the extension is a generator, so no filter on it slips into the join.
        near = (tokens.join(F.broadcast(part), "word")
                .select("_row", "_id", "item", "need", "before", "after", F.size(words).alias("n"), pos.alias("pos"),
                        left.alias("_left"), right.alias("_right")))
        extents = F.array(F.struct(_matched(F.col("_left"), F.col("before")).alias("l"),
                                   _matched(F.col("_right"), F.col("after")).alias("r")))
        return (near.select("_row", "_id", "item", "need", "n", "pos", F.explode(extents).alias("e"))
                .select("_row", "_id", "item", "need", "n", "pos", "e.l", "e.r"))

    marked = found.unionByName(mark)
    hits = (_over_passes(marked, per_pass, runs)
            .where(F.col("item").isNull() | (F.col("l") + 1 + F.col("r") >= F.col("need")))
            .select("_row", "_id", "item", F.when(F.col("item").isNull(), F.col("n")).alias("n_words"),
                    (F.col("pos") - F.when(F.col("item").isNull(), 0).otherwise(F.col("l"))).alias("start"),
                    (F.col("pos") + F.when(F.col("item").isNull(), 0).otherwise(F.col("r") + 1)).alias("stop")))
    before = Window.partitionBy("_row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.lit(0))
    return (hits.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)))
            .groupBy("_row", "_id")
            .agg(F.max("n_words").cast("long").alias("n_words"), F.sum("fresh").alias("n_hit"),
                 F.array_sort(F.collect_set("item")).alias("items"),
                 F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("start", "stop", "item")))).alias("hits"))
            .select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", "hits"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an item window; the columns are those of ``docs``.

    Null and empty texts hold none and stay; whole texts are read, however long; equal rows stay or go together, and rows
    of one id are judged each by its own text, null ids too; an empty table, or no items, changes nothing.  Other columns
    pass through, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    plain = docs.toDF(*names)
    key = [F.coalesce(F.col(own[id_col]).cast("string"), F.lit("")).alias("_k"),
           F.xxhash64(F.coalesce(F.col(own[text_col]), F.lit(""))).alias("_h")]
    found = contaminated_words(plain.select(F.struct(*key).alias("_key"), F.col(own[text_col]).alias("text")),
                               items.select(F.col(item_col).alias("item_id"), F.col("text")), "_key", "text", "item_id", window)
    gone = cut_lineage(found.where("n_hit > 0").select("_key._k", "_key._h").distinct())
    return plain.select("*", *key).join(gone, ["_k", "_h"], "left_anti").select(*(F.col(v).alias(k) for k, v in own.items()))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s + 1 : s + m], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.s, dw.m, bw.item_id FROM dw JOIN bw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query(SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                               spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
