"""Streaming forms: sessions, slots and debouncing with watermarks, and file events merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.lifecycle import upsert


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events of sessions, each told once the watermark has passed its end. An event exactly at
    the gap belongs to the session, one second later begins another. The batch form is the truth for later events."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")


def slot_stream(events: DataFrame, width: str = "4 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling (or sliding) slots of the day and kind."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select("w.start", "w.end", "kind", "n")


def debounce_stream(events: DataFrame, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """path, last event and their number, once a path has been quiet: another event begins the wait anew."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", late).groupBy("path", w.alias("w")).agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ts"), F.count("*").alias("events")).select("path", "kind", "ts", "events")


def changed_files(events: DataFrame, records: DataFrame) -> DataFrame:
    """Created or changed files whose content isn't what the records have: a stream joined with a static table."""
    known = records.where("not deleted").select("path", F.col("hash").alias("known_hash"))
    return events.where(F.col("kind").isin("created", "modified")).join(known, "path", "left").where("known_hash is null or known_hash <> hash").drop("known_hash")


def apply_file_events(records: DataFrame, events: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Records after a micro-batch of events (path, kind, hash, target, version): the latest event of a path counts, so
    a deletion that a later event overtook is ignored, and so is an earlier change of a file that is gone.

    Deletes tombstone a file or all under a folder, moves rewrite paths of a file or folder, created and modified
    files are upserted. With roots (root), a file that moves out of all of them is deleted, and one that moves in from
    elsewhere is new.
    """
    latest = events.groupBy("path").agg(F.max_by(F.struct("kind", "hash", "target", "version"), "version").alias("e")).select("path", "e.*")
    moves = latest.where("kind = 'moved'").select(F.col("path").alias("old"), "target", "hash")
    gone = latest.where("kind = 'deleted'").select(F.col("path").alias("old"))
    above = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/"))
    # a file's own path and its folders, so that folder events are equi-joins
    heads = records.where("not deleted").select("file_id", "path", F.explode(above("path")).alias("old"))
    dead = heads.join(gone, "old", "left_semi").select("file_id").distinct().withColumn("dead", F.lit(True))
    moved = heads.join(moves.select("old", "target"), "old").groupBy("file_id").agg(F.max_by(F.concat("target", F.substr("path", F.length("old") + 1)), F.length("old")).alias("to"))
    out = records.join(dead, "file_id", "left").join(moved, "file_id", "left")
    arrived = latest.where("kind in ('created', 'modified')").select("path", "hash")
    if roots is not None:
        own = roots.select(F.regexp_replace("root", "/+$", "").alias("head")).distinct()
        inside = lambda df, path: df.join(df.select(path, F.explode(above(path)).alias("head")).join(own, "head", "left_semi").select(path).distinct().withColumn("inside", F.lit(True)), path, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
        left = inside(out.where("to is not null").select("to").distinct(), "to").where("not inside").select("to", F.lit(True).alias("left"))
        out = out.join(left, "to", "left").withColumns({"dead": F.coalesce("dead", "left"), "to": F.when(F.col("left").isNull(), F.col("to"))})
        known = heads.select("old").distinct()
        entered = inside(moves.join(known, "old", "left_anti").select(F.col("target").alias("path"), "hash"), "path").where("inside and hash is not null")
        arrived = arrived.unionByName(entered.select("path", "hash"))
    out = out.withColumns({"deleted": F.col("deleted") | F.coalesce("dead", F.lit(False)), "path": F.coalesce("to", "path")}).select(*records.columns)
    new = arrived.join(out.select("path", "file_id"), "path", "left")
    fresh = new.select(F.coalesce("file_id", F.sha2("path", 256)).alias("file_id"), "path", "hash", F.lit(False).alias("deleted"))
    return upsert(out.select("file_id", "path", "hash", "deleted"), fresh)


def merge_into(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: applies a batch to the current records and hands the result to `write` with its number, so
    that a batch that runs again replaces its own result."""
    return lambda batch, number: write(apply_file_events(read(), batch), number)
