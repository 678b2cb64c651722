"""Sharding by fixed virtual slots: records hash into slots, a versioned map of slots to shards is edited to rebalance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tremorline.llm.common import query
from tremorline.session import cut_lineage, shared_dir

SLOTS = 8192  # fixed for the life of a data set: the map has this many rows, whatever the number of records
OVERHEAD = 8  # bytes each record takes besides its text


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead of a record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes per virtual slot, from ``virtual_slot`` and ``size``; summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def edited_map(loads: DataFrame, shards: int, old: DataFrame | None = None, slots: int = SLOTS,
               tolerance: float = 0.0) -> DataFrame:
    """The next version of the map: ``version, virtual_slot, shard`` for every slot, empty ones included.

    A shard keeps its slots, largest first, up to its even share of all bytes (times ``1 + tolerance``); the others,
    and those of shards that are gone, go one by one, largest first, to the shard with the fewest bytes.  Without an
    ``old`` map every slot is dealt out that way.  Everything here is a table of ``slots`` rows.
    """
    spark = loads.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    now = every.join(loads, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    if old is None:
        now = now.withColumns({"shard": F.lit(None).cast("int"), "version": F.lit(0)})
    else:
        now = (now.join(old.select("virtual_slot", "shard", "version"), "virtual_slot", "left")
               .withColumn("shard", F.when(F.col("shard") < shards, F.col("shard"))))
    within = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    fair = F.sum("bytes").over(Window.partitionBy()) / shards * (1 + tolerance)
    held = F.col("shard").isNotNull() & ((F.col("bytes") == 0) | (F.sum("bytes").over(within) <= fair) | (F.row_number().over(within) == 1))
    now = now.withColumns({"held": held, "next": F.coalesce(F.max("version").over(Window.partitionBy()), F.lit(0))})
    ordered = F.array_sort(F.collect_list(F.when(~F.col("held"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))))
    kept = [F.coalesce(F.sum(F.when(F.col("held") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)) for i in range(shards)]
    start = F.struct(F.array(*kept).alias("loads"), F.array().cast("array<int>").alias("owners"))

    def give(done: Column, slot: Column) -> Column:
        least = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        loaded = F.transform(done["loads"], lambda v, i: F.when(i == least, v - slot["less"]).otherwise(v))
        return F.struct(loaded.alias("loads"), F.concat(done["owners"], F.array(least)).alias("owners"))

    dealt = (now.agg(ordered.alias("free"), start.alias("start"))
             .select("free", F.aggregate("free", F.col("start"), give)["owners"].alias("owners"))
             .select(F.explode(F.arrays_zip(F.col("free.virtual_slot").alias("slot"), F.col("owners").alias("owner"))).alias("g"))
             .select(F.col("g.slot").alias("virtual_slot"), F.col("g.owner").alias("owner")))
    version = F.col("next") + (0 if old is None else 1)
    return (now.join(dealt, "virtual_slot", "left")
            .select(version.cast("int").alias("version"), "virtual_slot", F.coalesce("owner", "shard").alias("shard")))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map table; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the latest."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add ``size`` and ``virtual_slot`` (columns of these names are replaced).  Null ids hash like any other value."""
    size, slot = size_of(F.col(text_col)), slot_of(F.col(id_col), slots=slots)
    return docs.withColumns({"size": size, "virtual_slot": slot})


def with_shards(records: DataFrame, slot_map: DataFrame, name: str = "shard") -> DataFrame:
    """Add the shard of each record (a column of that name is replaced); the map has a fixed number of rows."""
    own = F.broadcast(slot_map.select("virtual_slot", F.col("shard").alias(name)))
    return records.drop(name).join(own, "virtual_slot")


def numbered(records: DataFrame, order: list[str], rows_per_group: int = 20_000) -> DataFrame:
    """Add ``slot``: the place of a record in its shard, from 0 without gaps.

    A shard is never one task: rows are counted per part of a virtual slot, the counts give each part its first place,
    and rows are numbered inside parts of about ``rows_per_group`` rows.  Order inside a part: the columns ``order``;
    equal rows are interchangeable.
    """
    parts = 1 + records.count() // (SLOTS * rows_per_group)
    records = records.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), *order), F.lit(parts)))
    firsts = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (records.groupBy("shard", "virtual_slot", "_part").agg(F.count("*").alias("_rows"))
              .select("virtual_slot", "_part", F.coalesce(F.sum("_rows").over(firsts), F.lit(0)).alias("_first")))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "_part").orderBy(*order)) - 1
    return (records.withColumn("_place", place).join(counts, ["virtual_slot", "_part"])
            .withColumn("slot", F.col("_first") + F.col("_place")).drop("_part", "_first", "_place"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``size, virtual_slot, shard``, by the next version of the map stored at ``map_path``.

    Rows of one id share a slot.  Null texts count the overhead only; repeated rows all stay; an empty table still
    stores a map.  Columns called size, virtual_slot or shard are replaced.  Texts are not shuffled.
    """
    spark = docs.sparkSession
    sized = with_slots(docs, id_col, text_col)
    path = map_path or f"{shared_dir(spark)}/slot_maps/{uuid.uuid4().hex}"
    store_map(edited_map(slot_loads(sized), shards), path)
    return with_shards(sized, load_map(spark, path))


@query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = cut_lineage(with_slots(docs).select("doc_id", "size", "virtual_slot",
                                               F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    path = f"{shared_dir(spark)}/slot_maps/{uuid.uuid4().hex}"
    store_map(edited_map(slot_loads(slim), 24), path)
    placed = numbered(with_shards(slim, load_map(spark, path)), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
