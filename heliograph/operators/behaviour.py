"""What events tell: sessions, decayed activity, habits, co-occurrence and recommendations, for many users at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, EVENT_WEIGHTS, NOW, SHOWN_RESULTS, SHOWN_WEIGHT, Settings, STOP_WORDS


def sessions(events: DataFrame, gap: float = DEFAULTS.session_gap_s) -> DataFrame:
    """Adds session (number within the user): a new one begins after more than `gap` seconds of silence."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(line)) > gap, F.lit(True)).cast("long")
    return events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(line)).drop("fresh")


def session_summary(events: DataFrame, gap: float = DEFAULTS.session_gap_s) -> DataFrame:
    """user_id, session, first, last, events, and the session's files in the order of their first use, once each."""
    files = F.sort_array(F.collect_list(F.when(F.col("kind") != "query", F.struct("ts", "event_id", "doc_id"))))
    return sessions(events, gap).groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"), F.array_join(F.array_distinct(F.transform(files, lambda f: f["doc_id"])), ",").alias("files"))


def current_session(events: DataFrame, now: float = NOW, gap: float = DEFAULTS.session_gap_s) -> DataFrame:
    """Each user's latest session, if it isn't over by `now`."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("session"))
    return session_summary(events, gap).withColumn("n", F.row_number().over(latest)).where((F.col("n") == 1) & (F.lit(now) - F.col("last") <= gap)).drop("n")


def kind_weight() -> Column:
    """The weight of an event by its kind."""
    return F.create_map(*[F.lit(x) for p in EVENT_WEIGHTS.items() for x in p])[F.col("kind")]


def decay(ts: Column, now: float, s: Settings = DEFAULTS) -> Column:
    age = F.when(ts < now, F.lit(now) - ts).when(ts.isNotNull(), 0.0)  # null for what never happened
    return F.pow(F.lit(0.5), age / s.half_life_s)


def weighted(events: DataFrame, now: float = NOW) -> DataFrame:
    """user_id, doc_id, w: an event's weight after decay; each of a query's first five results counts a little."""
    used = events.where("kind <> 'query'").select("user_id", "doc_id", (kind_weight() * decay(F.col("ts"), now)).alias("w"))
    shown = events.where("kind = 'query'").select("user_id", F.explode(F.slice("results", 1, SHOWN_RESULTS)).alias("doc_id"), (F.lit(SHOWN_WEIGHT) * decay(F.col("ts"), now)).alias("w"))
    return used.unionByName(shown)


def activity(events: DataFrame, active: DataFrame, now: float = NOW) -> DataFrame:
    """user_id, doc_id, score, share of the user's best; only active files count."""
    raw = weighted(events, now).groupBy("user_id", "doc_id").agg(F.sum("w").alias("score")).join(active.select("doc_id"), "doc_id", "left_semi")
    top = F.max("score").over(Window.partitionBy("user_id"))
    return raw.select("user_id", "doc_id", F.round("score", 6).alias("score"), F.round(F.when(top > 0, F.col("score") / top), 6).alias("normalised"))


def type_shares(events: DataFrame, records: DataFrame, now: float = NOW) -> DataFrame:
    """user_id, ext, share of decayed weight; inactive files count, queries don't."""
    used = events.where("kind <> 'query'").select("user_id", "doc_id", (kind_weight() * decay(F.col("ts"), now)).alias("w"))
    by = used.join(records.select("doc_id", "ext"), "doc_id").groupBy("user_id", "ext").agg(F.sum("w").alias("w"))
    return by.select("user_id", "ext", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("user_id")), 6).alias("share"))


def slots(events: DataFrame) -> DataFrame:
    """Adds weekday (Monday is 0) and slot (four hours each)."""
    return events.withColumns({"weekday": F.weekday("at").cast("long"), "slot": F.floor(F.hour("at") / DEFAULTS.slot_hours).cast("long")})


def slot_histogram(events: DataFrame) -> DataFrame:
    return slots(events.where("kind <> 'query'")).groupBy("user_id", "weekday", "slot").agg(F.count("*").alias("n"))


def usual_slot(events: DataFrame) -> DataFrame:
    """user_id, doc_id, weekday, slot, n: the fullest cell, the first in row order among equals."""
    by = slots(events.where("kind <> 'query'")).groupBy("user_id", "doc_id", "weekday", "slot").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("weekday", "slot", "n"), F.struct("n", -F.col("weekday"), -F.col("slot"))).alias("b")
    return by.groupBy("user_id", "doc_id").agg(best).select("user_id", "doc_id", "b.weekday", "b.slot", "b.n")


#: Files of a session that meet in one group; of a larger session every two blocks meet in a group of their own.
SESSION_BLOCK = 512


def _together(events: DataFrame, active: DataFrame, gap: float) -> DataFrame:
    """user_id, session and doc_id: the different active files of each session."""
    return sessions(events.where("kind <> 'query'"), gap).select("user_id", "session", "doc_id").distinct().join(active.select("doc_id"), "doc_id", "left_semi")


def cooccurrence(events: DataFrame, active: DataFrame, gap: float = DEFAULTS.session_gap_s, most: int | None = None) -> DataFrame:
    """user_id, a, b, sessions: active files that were used in one session, in how many.

    The result of a session is all pairs of its files. Files of a session of more than SESSION_BLOCK are dealt into blocks, every two of which
    meet by themselves. With `most`, sessions of more files than that, which no person has, are left out."""
    used, key = _together(events, active, gap), ["user_id", "session"]
    size = used.groupBy(*key).count()
    size = (size if most is None else size.where(F.col("count") <= most)).select(*key, F.ceil(F.col("count") / SESSION_BLOCK).cast("int").alias("blocks"))
    dealt = used.join(size, key).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select(*key, F.col("doc_id").alias("a"), F.col("own").alias("i"), every.alias("j"))
    right = dealt.select(*key, F.col("doc_id").alias("b"), F.col("own").alias("j"), every.alias("i"))
    return left.join(right, [*key, "i", "j"]).where("a <> b").groupBy("user_id", "a", "b").agg(F.count("*").alias("sessions"))


def likely_next(events: DataFrame, active: DataFrame, gap: float = DEFAULTS.session_gap_s, k: int = DEFAULTS.list_size, now: float = NOW) -> DataFrame:
    """user_id, doc_id, votes, rank: files that went along with those of the last session, which are left out. A session
    votes for each of its files, as often as it has files of the last one; so no pairs are made."""
    numbered = sessions(events.where("kind <> 'query'"), gap)
    last = numbered.join(numbered.groupBy("user_id").agg(F.max("session").alias("session")), ["user_id", "session"]).select("user_id", F.col("doc_id").alias("a")).distinct()
    used = _together(events, active, gap)
    weights = used.join(last.withColumnRenamed("a", "doc_id"), ["user_id", "doc_id"]).groupBy("user_id", "session").agg(F.count("*").alias("n"))
    votes = used.join(weights, ["user_id", "session"]).groupBy("user_id", "doc_id").agg(F.sum("n").alias("votes"))
    votes = votes.join(last.withColumnRenamed("a", "doc_id"), ["user_id", "doc_id"], "left_anti").join(activity(events, active, now).select("user_id", "doc_id", "normalised"), ["user_id", "doc_id"], "left")
    line = Window.partitionBy("user_id").orderBy(F.desc("votes"), F.desc_nulls_last("normalised"), F.desc("doc_id"))
    return votes.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= k).select("user_id", "doc_id", "votes", "rank")


def usual_now(events: DataFrame, active: DataFrame, weekday: int, slot: int, now: float = NOW, s: Settings = DEFAULTS) -> DataFrame:
    """user_id, doc_id, value, rank: files with at least two events and 0.4 of all of theirs in this slot, by that share
    times frequency."""
    used = slots(events.where("kind <> 'query'"))
    by = used.groupBy("user_id", "doc_id").agg(F.count("*").alias("n"), F.sum(F.when((F.col("weekday") == weekday) & (F.col("slot") == slot), 1).otherwise(0)).alias("here"))
    good = by.where((F.col("here") >= s.slot_events) & (F.col("here") / F.col("n") >= s.slot_share)).join(activity(events, active, now), ["user_id", "doc_id"])
    line = Window.partitionBy("user_id").orderBy(F.desc("value"), F.desc("doc_id"))
    return good.withColumn("value", F.round(F.col("here") / F.col("n") * F.col("normalised"), 6)).withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= s.list_size).select("user_id", "doc_id", "value", "rank")


def recent_ranked(events: DataFrame, active: DataFrame, excluded: DataFrame | None = None, now: float = NOW, s: Settings = DEFAULTS) -> DataFrame:
    """user_id, doc_id, value, rank: frequency times (0.5 + 0.5 recency), without files of the other lists."""
    touched = events.where("kind <> 'query'").groupBy("user_id", "doc_id").agg(F.max("ts").alias("last"))
    base = activity(events, active, now).join(touched, ["user_id", "doc_id"])
    if excluded is not None:
        base = base.join(excluded.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti")
    line = Window.partitionBy("user_id").orderBy(F.desc("value"), F.desc("doc_id"))
    return base.withColumn("value", F.round(F.col("normalised") * (0.5 + 0.5 * decay(F.col("last"), now)), 6)).withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= s.list_size).select("user_id", "doc_id", "value", "rank")


def cold_start(events: DataFrame, records: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """user_id, doc_id, rank for users with fewer than 20 events: the files changed last."""
    few = events.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") < s.cold_start).select("user_id")
    newest = records.where("not deleted and indexed").orderBy(F.desc("modified_time"), F.desc("doc_id")).limit(s.list_size)
    place = F.row_number().over(Window.orderBy(F.desc("modified_time"), F.desc("doc_id"))).cast("long")
    return few.join(F.broadcast(newest.withColumn("rank", place))).select("user_id", "doc_id", "rank")  # five rows


def frequently_used(events: DataFrame, records: DataFrame, now: float = NOW, days: int = 30, least: int = 3, k: int = 50) -> DataFrame:
    """path and opens of the last days, at least three, the 50 most opened."""
    opened = events.where((F.col("kind") == "file_opened") & (F.col("ts") >= now - days * 86400)).join(records.select("doc_id", F.lower("path").alias("path")), "doc_id")
    by = opened.groupBy("path").agg(F.count("*").alias("opens")).where(F.col("opens") >= least)
    return by.orderBy(F.desc("opens"), "path").limit(k)


def time_affinity(events: DataFrame, weekday: int, slot: int) -> DataFrame:
    """min(1, 0.6 x share of the slot + 0.4 x 7 x share of the slot on this weekday) of each file's events."""
    used = slots(events.where("kind <> 'query'"))
    same = F.sum(F.when(F.col("slot") == slot, 1).otherwise(0)) / F.count("*")
    both = F.sum(F.when((F.col("slot") == slot) & (F.col("weekday") == weekday), 1).otherwise(0)) / F.count("*")
    return used.groupBy("user_id", "doc_id").agg(F.round(F.least(F.lit(1.0), 0.6 * same + 0.4 * 7 * both), 6).alias("affinity"))


#: Components of centroids that are sent to all tasks; more are joined component by component.
SENT = 1 << 20


def topic_affinity(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, topic, affinity: the largest cosine with a centroid (topic, i, x), at least 0. Centroids are few and go to
    the vectors, which then need no exchange; too many are joined with them on the dimension."""
    if centroids.count() <= SENT:
        rows = centroids.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).orderBy("topic").collect()
        if not rows:
            return vectors.select("vec_id", F.lit(None).cast("long").alias("topic"), F.lit(0.0).alias("affinity")).where("false")
        names, centres = [r.topic for r in rows], np.array([[x or 0.0 for x in r.x] for r in rows])
        kind = centroids.schema["topic"].dataType.simpleString()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                length = np.sqrt((own**2).sum(1))
                cosine = (own @ centres.T / np.where(length > 0, length, 1)[:, None]).round(6)
                best = cosine.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best]).cast(pa.int64() if kind in ("bigint", "int") else pa.string()), pa.array(np.maximum(cosine[np.arange(len(best)), best], 0.0))], ["vec_id", "topic", "affinity"])

        return vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(each, f"vec_id long, topic {'long' if kind in ('bigint', 'int') else 'string'}, affinity double")
    flat = vectors.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    dots = flat.join(centroids, "i").groupBy("vec_id", "topic").agg(F.round(F.sum(F.col("v") * F.col("x")) / F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("cosine"))
    best = F.max_by(F.struct("topic", "cosine"), F.struct("cosine", -F.col("topic"))).alias("b")
    return dots.groupBy("vec_id").agg(best).select("vec_id", "b.topic", F.greatest(F.col("b.cosine"), F.lit(0.0)).alias("affinity"))


#: What an occurrence in a file's name weighs beside one in its text.
NAME_WEIGHT = 3


def topic_labels(tokens: DataFrame, k: int = 3) -> DataFrame:
    """topic, term, rank from (topic, term, score): occurrences weighted by 0.25 + score, rare terms first. With a column
    in_name those of names weigh three times as much, and stop words count in names only."""
    if "in_name" in tokens.columns:
        tokens = tokens.where(F.col("in_name") | ~F.col("term").isin(*STOP_WORDS))
    times = F.when(F.col("in_name"), NAME_WEIGHT).otherwise(1) if "in_name" in tokens.columns else F.lit(1)
    by = tokens.withColumn("score", times * (0.25 + F.col("score")) - 0.25).groupBy("topic", "term").agg(F.sum(0.25 + F.col("score")).alias("w"))
    df = by.groupBy("term").agg(F.count("*").alias("df"))
    most = df.agg(F.max("df").alias("most"))
    scored = by.join(df, "term").join(F.broadcast(most)).withColumn("value", F.round(F.col("w") * F.log(1 + F.col("most") / F.col("df")), 6))  # one row
    line = Window.partitionBy("topic").orderBy(F.desc("value"), "term")
    return scored.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= k).select("topic", "term", "value", "rank")


def topics(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """vec_id and topic by k-means on cosine distance; k is half the number of files, between 1 and 5. A column score
    weighs the files."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    weight = F.col("score").cast("double") if "score" in vectors.columns else F.lit(1.0)
    ready = vectors.select("vec_id", array_to_vector("embedding").alias("features"), weight.alias("weight"))
    if n < 2:
        return vectors.select("vec_id", F.lit(0).alias("topic"))
    model = KMeans(k=max(2, min(5, n // 2)), seed=seed, maxIter=25, distanceMeasure="cosine", weightCol="weight").fit(ready)
    return model.transform(ready).select("vec_id", F.col("prediction").alias("topic"))
