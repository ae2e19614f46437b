"""Records, vectors and usage events as snapshots: every write is a set operation that gives the next table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, NOW
from heliograph.operators.lifecycle import retention, tombstone, upsert
from heliograph.sources.tables import written

EVENTS = "event_id long, ts double, kind string, file_id string, path string, query string, source string, session long"

# -- records ---------------------------------------------------------------------------------------------------------


def lookup(records: DataFrame, asked: DataFrame, key: str = "path") -> DataFrame:
    """Each asked key (a path or a file_id) with its record: an exact path before one that differs in case, a live row
    before a tombstone, then the smallest file_id. Keys without a record have none."""
    folded = F.lower(key) if key == "path" else F.col(key)
    wanted = asked.select(F.col(key).alias("asked"), folded.alias("_key")).distinct()
    met = wanted.join(records.withColumn("_key", folded), "_key")
    line = Window.partitionBy("asked").orderBy(F.desc(F.col(key) == F.col("asked")), "deleted", "file_id")
    return met.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n", "_key")


def rename(records: DataFrame, moves: DataFrame) -> DataFrame:
    """records with the new path of moves (old_path, path); hashes, and so chunks and vectors, stay. A record that held
    the new path gives way."""
    moved = records.join(moves.select(F.col("old_path").alias("path"), F.col("path").alias("_new")), "path").withColumn("path", F.col("_new")).drop("_new")
    return upsert(records, moved.select(*records.columns))


def forget(records: DataFrame, log: DataFrame, keys: DataFrame, now: float = NOW, logged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tombstones for files (file_id), and the deletion log (file_id, path, deleted_at) with a row for each live one,
    without rows past their retention."""
    gone = records.where("not deleted").join(keys.select("file_id").distinct(), "file_id", "left_semi")
    more = gone.select("file_id", "path", F.lit(now).cast("double").alias("deleted_at"))
    return tombstone(records, keys), retention(log.unionByName(more) if logged else log, now)


def copied_chunks(chunks: DataFrame, reuse: DataFrame) -> DataFrame:
    """Chunks of files (doc_id) whose content another one (reuse_from) has: the donor's, under the new file."""
    own = chunks.join(reuse.select(F.col("reuse_from").alias("doc_id"), F.col("doc_id").alias("_to")), "doc_id")
    number = F.substring_index("chunk_id", "#", -1)
    return own.withColumn("chunk_id", F.concat_ws("#", F.col("_to").cast("string"), number)).withColumn("doc_id", F.col("_to")).select(*chunks.columns)


def put_vectors(old: DataFrame, new: DataFrame, key: str = "chunk_id", replace: bool = True) -> DataFrame:
    """New rows beside the old ones; with replace, in place of those with the same key."""
    kept = old.join(new.select(key).distinct(), key, "left_anti") if replace else old
    return kept.select(*old.columns).unionByName(new)


def for_model(vectors: DataFrame, records: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """vectors (with model) and records after a change of model: vectors of others are dropped and their files are
    marked as not indexed."""
    kept = vectors.where(F.col("model") == model)
    lost = vectors.where(~F.col("model").eqNullSafe(F.lit(model))).select("doc_id").distinct().withColumn("_lost", F.lit(True))
    return kept, records.join(lost, "doc_id", "left").withColumn("indexed", F.col("indexed") & F.col("_lost").isNull()).select(*records.columns)


def library_size(vectors: DataFrame) -> DataFrame:
    """kind and the number of its vectors."""
    return vectors.groupBy("kind").agg(F.count("*").alias("n"))


# -- usage events ----------------------------------------------------------------------------------------------------


def session_ends(events: DataFrame) -> DataFrame:
    """Where each user's live events (without a source) end: the latest ts and the last session."""
    return events.where("source is null").groupBy(*_users(events)).agg(F.max("ts").alias("ts"), F.max("session").alias("session"))


def _users(events: DataFrame, *more: str) -> list[str]:
    return [c for c in ("user_id", *more) if c in events.columns]


def _who(events: DataFrame, *more: str) -> Column:
    """What has sessions of its own, nulls too, as one value: a user; without a user_id all is one user's."""
    return F.to_json(F.struct(F.lit(1).alias("log"), *_users(events, *more)))


def with_sessions(events: DataFrame, gap: float = DEFAULTS.session_gap_s, ends: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """events in the order of arrival (event_id), with session, numbered by user_id (and the columns `by`): a new one begins
    when ts is more than the gap after the user's latest ts so far. Without a user_id all events are one user's. ends: where an earlier table
    ended by user (user_id, ts, session).

    The log is dealt into blocks by user and event_id, so that a user with most of the events has many. What a block has to
    know of the user's earlier ones is their latest ts, and then how many sessions they began: a row for each block and user. So no
    task holds more than a block, and none waits for another.
    """
    rows = events.select(_who(events, *by).alias("who"), "event_id", "ts", F.struct("*").alias("row"))
    placed = written(rows.repartitionByRange("who", "event_id").withColumn("block", F.spark_partition_id()))
    key = ["who", "block"]
    earlier = Window.partitionBy("who").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = placed.groupBy(*key).agg(F.max("ts").alias("top")).withColumn("before", F.max("top").over(earlier))
    if ends is None:
        known = known.withColumn("number", F.lit(0).cast("long"))
    else:
        old = ends.select(_who(ends, *by).alias("who"), F.col("ts").alias("end"), F.col("session").alias("number"))
        known = known.join(old, "who", "left").withColumns({"before": F.greatest("before", "end"), "number": F.coalesce("number", F.lit(0))})
    line = Window.partitionBy(*key).orderBy("event_id", "ts")
    latest = F.greatest(F.max("ts").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    fresh = (latest.isNull() | (F.col("ts") - latest > gap)).cast("long")
    marked = written(placed.join(known.select(*key, "before", "number"), key).withColumn("fresh", fresh).withColumn("upto", F.sum("fresh").over(line)))
    begun = marked.groupBy(*key).agg(F.sum("fresh").alias("n")).select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("so_far"))
    return marked.join(begun, key).select("row.*", (F.col("number") + F.col("so_far") + F.col("upto")).cast("long").alias("session"))


def append_events(events: DataFrame, new: DataFrame, gap: float = DEFAULTS.session_gap_s, ends: DataFrame | None = None) -> DataFrame:
    """The log with new events, which go on with their user's last session if they come soon enough. ends: session_ends of
    the log, if they are kept beside it; else they are read from it."""
    numbered = with_sessions(new.drop("session"), gap, session_ends(events) if ends is None else ends)
    return events.unionByName(numbered.select(*events.columns))


def replace_source(events: DataFrame, source: str, new: DataFrame, gap: float = DEFAULTS.session_gap_s) -> DataFrame:
    """Imported events of a source swapped for new ones, in one table: readers see the old or the new whole. Imports
    have sessions of their own, numbered after all others of their user."""
    kept = clear_source(events, source)
    top = events.groupBy(_who(events).alias("_who")).agg(F.max("session").alias("_top"))
    own = with_sessions(new.drop("session").withColumn("source", F.lit(source)), gap)
    own = own.withColumn("_who", _who(own)).join(top, "_who", "left").withColumn("session", F.col("session") + F.coalesce("_top", F.lit(0)))
    return kept.unionByName(own.select(*events.columns))


def clear_source(events: DataFrame, source: str | None = None) -> DataFrame:
    """Without the events of a source; without a name, no event is left."""
    return events.where("false") if source is None else events.where(~F.col("source").eqNullSafe(F.lit(source)))


def newest(events: DataFrame, limit: int) -> DataFrame:
    """Each user's newest events, those with the largest id first where times are equal."""
    order = F.desc("ts"), F.desc("event_id")
    if not (users := _users(events)):
        return events.orderBy(*order).limit(limit)
    line = Window.partitionBy(*users).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= limit).drop("_n")


def recent(events: DataFrame, limit: int, kinds: tuple[str, ...] | None = None, since: float | None = None) -> DataFrame:
    """Each user's newest events of some kinds."""
    out = events if kinds is None else events.where(F.col("kind").isin(*kinds))
    return newest(out if since is None else out.where(F.col("ts") >= since), limit)


def all_events(events: DataFrame) -> DataFrame:
    return events.orderBy("ts", "event_id")


def imported(events: DataFrame, items: DataFrame) -> DataFrame:
    """Items (path, first, last) of a list of recent files as opens that the log doesn't have yet: the first, and the
    last if it is more than a minute later. Times are the same if they are to the millisecond."""
    opens = items.select("path", F.explode(F.array_compact(F.array("first", F.when(F.col("last") - F.col("first") > 60, F.col("last"))))).alias("ts"))
    known = events.select(F.lower("path").alias("_path"), F.round("ts", 3).alias("_ts")).distinct()
    keyed = opens.withColumn("_path", F.lower("path")).withColumn("_ts", F.round("ts", 3)).dropDuplicates(["_path", "_ts"])
    return keyed.join(known, ["_path", "_ts"], "left_anti").select("path", "ts")


def of_records(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items (path, ts) with the live record of their path, however it is written."""
    live = records.where("not deleted").select(F.lower("path").alias("_path"), "file_id")
    return items.withColumn("_path", F.lower("path")).join(live, "_path").drop("_path")


def newest_open(*opens: DataFrame) -> DataFrame:
    """path and ts of the newest open of each path over several lists (path, ts)."""
    return reduce(DataFrame.unionByName, [o.select("path", "ts") for o in opens]).groupBy(F.lower("path").alias("_path")).agg(F.max_by("path", F.struct("ts", "path")).alias("path"), F.max("ts").alias("ts")).drop("_path")


def sample_history(files: DataFrame, habits: DataFrame, now: float = NOW, days: int = 28, every: int = 3) -> DataFrame:
    """ts, kind, file_id, query: made-up events of the days before today. habits: habit, weekdays (Monday is 0), minute
    (of the day), query; files: habit, place, file_id. The files of a habit are opened two minutes apart on its days;
    on every third day it is searched for, a minute before."""
    today = F.lit(int(now // 86400 * 86400))
    day = habits.withColumn("ago", F.explode(F.sequence(F.lit(days), F.lit(1), F.lit(-1)))).withColumn("_day", today - F.col("ago") * 86400)
    weekday = F.weekday(F.timestamp_seconds("_day"))
    begin = (F.col("_day") + F.col("minute") * 60).cast("double")
    on = day.where(F.array_contains("weekdays", weekday))
    opens = on.join(files, "habit").select((begin + F.col("place") * 120).alias("ts"), F.lit("file_opened").alias("kind"), "file_id", F.lit(None).cast("string").alias("query"))
    asked = on.where((F.col("ago") % every == 0) & F.col("query").isNotNull()).select((begin - 60).alias("ts"), F.lit("query").alias("kind"), F.lit(None).cast(files.schema["file_id"].dataType).alias("file_id"), "query")
    return opens.unionByName(asked)


# -- failures --------------------------------------------------------------------------------------------------------


def ring(log: DataFrame, keep: int, by: str = "ts", key: str | None = None) -> DataFrame:
    """The newest rows of a bounded log, for each key if there is one."""
    if key is None:
        return log.orderBy(F.desc(by)).limit(keep)
    line = Window.partitionBy(key).orderBy(F.desc(by))
    return log.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= keep).drop("_n")


def settled(extracted: DataFrame, tries: int = 3) -> DataFrame:
    """Of extractions (path, attempt, hash_before, hash_after): for each path the first of at most three attempts during
    which the file didn't change; a path without one is left for the next scan."""
    good = extracted.where((F.col("hash_before") == F.col("hash_after")) & (F.col("attempt") <= tries))
    line = Window.partitionBy("path").orderBy("attempt")
    return good.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def to_index(listing: DataFrame, failures: DataFrame, markers: DataFrame, times: int = 2) -> DataFrame:
    """Files of a listing (path, hash) that are worth a try: none whose bytes failed for good (failures: hash,
    retryable), and none whose bytes were being read when the process ended, twice or more (markers: hash)."""
    hopeless = failures.where("not retryable").select("hash").union(markers.groupBy("hash").count().where(F.col("count") >= times).select("hash"))
    return listing.join(hopeless.distinct(), "hash", "left_anti")


def retryable(error: Column) -> Column:
    """Whether an error (its type's name) may go away by itself: of the system or of memory, not of the file."""
    return F.regexp_extract(error, r"^\w+", 0).isin("OSError", "IOError", "PermissionError", "FileNotFoundError", "TimeoutError", "ConnectionError", "InterruptedError", "BlockingIOError", "MemoryError")


def spans_at(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each chunk (doc_id, chunk_id, start_offset) with the place of the block (doc_id, start, end, page) that holds its
    beginning, else the last that starts before, else the first. An as-of join: both sides in one order, the last block
    seen is carried on, so no chunk meets every block of its document."""
    marks = blocks.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("turn"), F.struct("start", "end", "page").alias("block"), F.lit(None).cast("string").alias("chunk_id"))
    asked = chunks.select("doc_id", F.col("start_offset").alias("at"), F.lit(1).alias("turn"), F.lit(None).cast(marks.schema["block"].dataType).alias("block"), "chunk_id")
    line = Window.partitionBy("doc_id").orderBy("at", "turn", "block.end")
    seen = F.last("block", True).over(line)
    first = F.first("block", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    both = marks.unionByName(asked).withColumn("held", F.coalesce(seen, first))
    return both.where("turn = 1").select("doc_id", "chunk_id", "held.start", "held.page")
