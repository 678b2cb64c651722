"""Preference formatting: one prompt for the common turns of a chosen and a rejected conversation, masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tremorline.llm.common import query

#: How a turn is written; only the text and the closing mark of assistant turns are trained on.
OPEN, AFTER_ROLE, CLOSE, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def numbered_turns(turns: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """Add ``place``: the number of a turn in its conversation from 0, by turn (null first), role and text.

    Turns are numbered in blocks of ``block`` turn numbers, and the sizes of earlier blocks are added, so that one very
    long conversation is no single task.
    """
    turns = turns.withColumn("_block", F.floor(F.col("turn") / block))
    sizes = turns.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col(key).alias("_key"), F.col("_block").alias("_own"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    return (turns.withColumn("_inside", inside)
            .join(firsts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_own")))
            .withColumn("place", F.col("_first") + F.col("_inside"))
            .drop("_block", "_key", "_own", "_first", "_inside"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, segment_turns: int = 4096) -> DataFrame:
    """Prompt and masked completions of each pair, from two tables of turns ``pair_id, turn, role, text``.

    The prompt is the longest common prefix of turns (role and text), written once.  Completions are the remaining
    turns.  A mask lists the character ranges ``start-stop`` of a completion that are trained on: text and closing mark
    of assistant turns.  One row per pair and ``segment``: a part of more than ``segment_turns`` turns goes on in the
    next segment, with offsets of its own, so no row grows with a conversation.  A pair that only one table has has no
    prompt; equal conversations have no completions.  Null roles and texts are ''; a null pair id is a pair; repeated
    turns are turns; empty tables give an empty table; other columns are ignored.
    """
    def side(turns: DataFrame, name: str) -> DataFrame:
        plain = turns.select("pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text"))
        return numbered_turns(plain, "pair_id").withColumn("side", F.lit(name))

    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    turn_hash = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    places = both.select("pair_id", "place", turn_hash.alias("h")).groupBy("pair_id", "place").agg(
        F.count("*").alias("sides"), F.min("h").alias("low"), F.max("h").alias("high"))
    differs = (F.col("sides") < 2) | (F.col("low") != F.col("high"))
    common = places.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("place"))), F.count("*")).alias("n_prompt_turns"))
    common = common.select(F.col("pair_id").alias("_pair"), "n_prompt_turns")
    shared = F.col("place") < F.col("n_prompt_turns")
    placed = (both.join(common, F.col("pair_id").eqNullSafe(F.col("_pair"))).drop("_pair")
              .where(~shared | (F.col("side") == "chosen"))
              .withColumns({"part": F.when(shared, "prompt").otherwise(F.col("side")),
                            "at": F.when(shared, F.col("place")).otherwise(F.col("place") - F.col("n_prompt_turns"))})
              .withColumns({"segment": F.floor(F.col("at") / segment_turns), "piece": rendered(F.col("role"), F.col("text"))}))
    before = Window.partitionBy("pair_id", "part", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length(F.concat(F.lit(OPEN), "role", F.lit(AFTER_ROLE)))
    trained = F.when((F.col("role") == TRAINED) & (F.col("part") != "prompt"), F.concat(
        F.col("start").cast("string"), F.lit("-"), (F.col("start") + F.length("text") + len(CLOSE)).cast("string")))
    pieces = placed.withColumn("start", start).withColumn("range", trained)

    def text_of(part: str, column: str, glue: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col(column).isNotNull(), F.struct("at", column))))
        return F.array_join(F.transform(listed, lambda x: x[column]), glue)

    return pieces.groupBy("pair_id", "segment", "n_prompt_turns").agg(
        text_of("prompt", "piece", "").alias("prompt"), text_of("chosen", "piece", "").alias("chosen"),
        text_of("rejected", "piece", "").alias("rejected"), text_of("chosen", "range", ",").alias("chosen_mask"),
        text_of("rejected", "range", ",").alias("rejected_mask"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Rejected conversations for a table without preferences: the last assistant turn is that of the next id, or ''."""
    last = (turns.where(F.col("role") == TRAINED).groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text"))
    own = last.select("conv_id", F.col("turn").alias("_turn"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("_other"))
    swap = (F.col("turn") == F.col("_turn")) & (F.col("role") == TRAINED)
    return (turns.join(own.join(other, "conv_id", "left"), "conv_id", "left")
            .withColumn("text", F.when(swap, F.coalesce("_other", F.lit(""))).otherwise(F.col("text"))).drop("_turn", "_other"))


SQL = """
WITH last AS (SELECT conv_id, max(turn) AS lt, arg_max(text, (turn, text)) AS lx FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id AS pair_id, 'chosen' AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations
      UNION ALL
      SELECT t.conv_id, 'rejected', coalesce(t.role, ''),
             CASE WHEN t.turn = l.lt AND t.role = 'assistant' THEN coalesce(o.lx, '') ELSE coalesce(t.text, '') END, t.turn
      FROM conversations t LEFT JOIN last l ON l.conv_id = t.conv_id LEFT JOIN last o ON o.conv_id = t.conv_id + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM c),
p AS (SELECT pair_id, place, count(*) < 2 OR min(role || chr(1) || text) <> max(role || chr(1) || text) AS differs FROM n GROUP BY ALL),
k AS (SELECT pair_id, coalesce(min(CASE WHEN differs THEN place END), count(*)) AS n_prompt_turns FROM p GROUP BY pair_id),
r AS (SELECT n.pair_id, n_prompt_turns, role, text, CASE WHEN place < n_prompt_turns THEN 'prompt' ELSE side END AS part,
             CASE WHEN place < n_prompt_turns THEN place ELSE place - n_prompt_turns END AS pos,
             '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
      FROM n JOIN k ON n.pair_id IS NOT DISTINCT FROM k.pair_id WHERE place >= n_prompt_turns OR side = 'chosen'),
s AS (SELECT *, pos // 4096 AS segment,
             coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, part, pos // 4096 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + length(role) + 5 AS start FROM r)
SELECT pair_id, segment, n_prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY pos) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(start || '-' || (start + length(text) + 8), ',' ORDER BY pos) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(start || '-' || (start + length(text) + 8), ',' ORDER BY pos) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id, segment, n_prompt_turns
"""


@query(SQL)
def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_pairs(turns.withColumnRenamed("conv_id", "pair_id"), swapped_answers(turns).withColumnRenamed("conv_id", "pair_id"))
