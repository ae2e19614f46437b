"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialise, private, restored, table

SHARDS = 8


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes, none for a null text, plus 1) and CRC-32 of the text; the texts stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _prefixed(slim: DataFrame) -> DataFrame:
    """Adds ``before`` (bytes of all earlier rows) and ``place`` (number of earlier rows) in the order of
    doc_id, CRC-32 and size.

    Equal rows of an input partition travel as one with their number, so that a row repeated very often is dealt out, too.
    The rows are dealt by range and written with the number of their partition. Only that number's totals (a
    row for each partition) meet in one task; the sums within partitions run in parallel.
    """
    order = ["doc_id", "text_crc32", "size", "origin"]
    slim = slim.withColumn("origin", F.spark_partition_id()).groupBy(*order).agg(F.count("*").alias("times"))
    dealt = materialise(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum(F.col("size") * F.col("times")).alias("bytes"), F.sum("times").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return (
        dealt.withColumns({"bytes": upto(F.col("size") * F.col("times")), "rows": upto(F.col("times"))})
        .join(F.broadcast(offsets), "part")  # a row for each partition of the shuffle
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        .withColumns({
            "before": F.col("bytes_before") + F.col("bytes") + F.col("k") * F.col("size"),
            "place": F.col("rows_before") + F.col("rows") + F.col("k"),
        })
    )


def contiguous_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deals all documents into ``shards`` contiguous ranges of doc_id with nearly equal bytes.

    Takes doc_id and text; other columns are ignored, whatever their names. Returns doc_id, size, text_crc32,
    law (``bytes``), shard (0-based), slot (gapless from 0 within the shard), grown_shard (null: it belongs to
    another law). A row goes to the shard in which its first byte falls, so a shard is off its target by less
    than the two rows at its ends.

    The law is ``bytes``, which is about sizes alone: a group of equal texts may be larger than a shard, so it may lie
    in several, as its rows' doc_ids do.

    A null text has size 1 and CRC-32 0, like an empty one. A null doc_id comes first. Equal doc_ids are
    ordered by CRC-32, then size; repeated rows are interchangeable. An empty table gives an empty result.
    Very long texts cost no memory, as only their sizes travel.
    """
    placed = _prefixed(_sized(docs)).withColumn(
        "shard", F.expr(f"cast((before * {shards}) div total as int)")
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # at most `shards` rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of docs with a column ``shard``: the same cuts as contiguous_shards, without moving texts.

    The cuts are the first key (doc_id, CRC-32, size) of each shard, at most ``shards`` rows; each document finds
    its shard by comparing its own key with them. Rows with equal keys stay together. A column named shard is
    replaced. Nulls: as contiguous_shards.
    """
    key = F.struct("doc_id", "text_crc32", "size")
    placed = _prefixed(_sized(docs)).withColumn("shard", F.expr(f"cast((before * {shards}) div total as int)"))
    cuts = placed.groupBy("shard").agg(F.min(key).alias("cut")).agg(F.collect_list("cut").alias("_cuts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(
        F.col("doc_id"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
    )
    # shards with no row of their own (very few, very long texts) have no cut, so the numbers are dense here
    docs = docs.drop("shard")
    rows = (
        private(docs, "doc_id", "text")
        .withColumn("_key", own)
        .join(F.broadcast(cuts))  # one row of at most `shards` keys
        .withColumn("_shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_key"))) - F.lit(1))
    )
    return restored(rows, docs, "doc_id", "text", shard="_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contiguous_shards(table(spark, sf_dir, "documents"))
