"""Indexing as set operations: snapshot differences, renames, upserts, purges, retention, roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, NOW


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, hash, status of two listings (path, hash): unchanged, modified, new, renamed (a new path with the hash of
    a file whose path is gone) or deleted. One full join by path; renames by hash, each old file used once."""
    both = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    fresh = both.where("old_hash is null").select("path", F.col("new_hash").alias("hash"))
    gone = both.where("new_hash is null").select(F.col("path").alias("old_path"), F.col("old_hash").alias("hash"))
    number = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(by)))
    pairs = number(fresh, "path").join(number(gone, "old_path"), ["hash", "n"]).select("path", "old_path")
    kept = both.where("old_hash is not null and new_hash is not null").select("path", F.col("new_hash").alias("hash"), F.when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified").alias("status"))
    added = fresh.join(pairs, "path", "left").select("path", "hash", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("new").alias("status"))
    lost = gone.join(pairs.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), "hash", F.lit("deleted").alias("status"))
    return kept.union(added).union(lost)


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path and path of files that moved without a change."""
    gone = old.join(new, "path", "left_anti").select(F.col("path").alias("old_path"), "hash")
    fresh = new.join(old, "path", "left_anti").select("path", "hash")
    number = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(by)))
    return number(fresh, "path").join(number(gone, "old_path"), ["hash", "n"]).select("old_path", "path")


def upsert(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """New rows replace old ones with the same key; an old row of another key that holds a new row's path is parked
    under path, NUL and key."""
    kept = old.join(new.select(key), key, "left_anti")
    taken = new.select("path").distinct().withColumn("taken", F.lit(True))
    parked = kept.join(taken, "path", "left").withColumn("path", F.when(F.col("taken"), F.concat("path", F.lit("\x00"), key)).otherwise(F.col("path"))).drop("taken")
    return parked.select(*old.columns).unionByName(new)


def tombstone(records: DataFrame, keys: DataFrame, key: str = "file_id") -> DataFrame:
    return records.join(keys.select(key).distinct().withColumn("gone", F.lit(True)), key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).drop("gone").select(*records.columns)


def purge(rows: DataFrame, records: DataFrame, key: str = "file_id") -> DataFrame:
    """Chunks or vectors without those of tombstones."""
    return rows.join(records.where("deleted").select(key), key, "left_anti")


def retention(log: DataFrame, now: float = NOW, keep: float = DEFAULTS.retention_s) -> DataFrame:
    return log.where(F.col("deleted_at") >= now - keep)


def duplicate_reuse(records: DataFrame) -> DataFrame:
    """file_id and reuse_from: an indexed, live file with the same content, the smallest other one, whose chunks can be
    copied. From each content's two smallest live files, so a large group is never paired."""
    live = records.where("not deleted and indexed").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("doc_id"))).where("n <= 2")
    two = live.groupBy("hash").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other"))
    other = F.when(F.col("one") != F.col("doc_id"), F.col("one")).when(F.col("other") != F.col("doc_id"), F.col("other"))
    return records.join(two, "hash").select("doc_id", other.alias("reuse_from")).where("reuse_from is not null")


def vanished(records: DataFrame, listing: DataFrame, unreachable: list[str]) -> DataFrame:
    """Live records that the walk didn't see, but for those under folders that couldn't be listed."""
    gone = records.where("not deleted").join(listing.select("path"), "path", "left_anti")
    for prefix in unreachable:
        gone = gone.where(~F.col("path").startswith(prefix.rstrip("/") + "/"))
    return gone


def deepest_root(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the deepest watched root above it: an equi-join of its parent folders with the roots."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return records.withColumn("root", F.explode(parents)).join(roots, "root").groupBy("doc_id").agg(F.max_by("root", F.length("root")).alias("root"))
