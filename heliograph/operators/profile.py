"""What is known of each user's habits, kept as versions: a new version reads only the events since the last one.

Decayed sums need no event again. All weights halve in the same time, so the sums of one moment are those of an earlier one,
scaled by one factor, and the new events' weights added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, SHOWN_RESULTS, SHOWN_WEIGHT, Settings
from heliograph.operators.behaviour import decay, kind_weight, slots
from heliograph.sources.tables import exists, removed

SUMS = "user_id long, doc_id long, used double, shown double"
CELLS = "user_id long, doc_id long, weekday long, slot long, n long"


def sums(events: DataFrame, now: float, s: Settings = DEFAULTS) -> DataFrame:
    """user_id, doc_id, used and shown: decayed weights of a file's use, and of its place among a query's first results."""
    none = F.lit(0.0)
    used = events.where("kind <> 'query'").select("user_id", "doc_id", (kind_weight() * decay(F.col("ts"), now, s)).alias("used"), none.alias("shown"))
    shown = events.where("kind = 'query'").select("user_id", F.explode(F.slice("results", 1, SHOWN_RESULTS)).alias("doc_id"), none.alias("used"), (F.lit(SHOWN_WEIGHT) * decay(F.col("ts"), now, s)).alias("shown"))
    return used.unionByName(shown).groupBy("user_id", "doc_id").agg(F.sum("used").alias("used"), F.sum("shown").alias("shown"))


def cells(events: DataFrame) -> DataFrame:
    """user_id, doc_id, weekday, slot and the number of uses."""
    return slots(events.where("kind <> 'query'")).groupBy("user_id", "doc_id", "weekday", "slot").agg(F.count("*").alias("n"))


class Profile:
    """Versions of all users' profiles in a folder. Events are user_id, ts (seconds), at, kind, doc_id and results.

    refresh() takes the events since the last version, late ones too, and the moment that their weights are told for. An event ahead of
    that moment counts in full; give such events to a later refresh, if there is one. A version is there once its entry is; one that
    broke off before is written again. The version before stays, so that its readers aren't cut off.
    """

    def __init__(self, spark: SparkSession, folder: str, s: Settings = DEFAULTS):
        self.spark, self.folder, self.settings = spark, folder, s

    def versions(self) -> list[tuple[int, float]]:
        """Numbers and moments of the versions, in order."""
        if not exists(self.spark, f"{self.folder}/versions"):
            return []
        return sorted(tuple(r) for r in self.spark.read.schema("version long, as_of double").parquet(f"{self.folder}/versions/*").collect())

    def _table(self, name: str, form: str, version: int) -> DataFrame:
        return self.spark.read.schema(form).parquet(f"{self.folder}/{name}/{version}")

    def refresh(self, events: DataFrame, now: float) -> int:
        known = self.versions()
        version = known[-1][0] + 1 if known else 1
        own, of = sums(events, now, self.settings), cells(events)
        if known:
            last, then = known[-1]
            if now < then:
                raise ValueError("a version can't be of an earlier moment than the one before")
            factor = F.lit(0.5 ** ((now - then) / self.settings.half_life_s))
            old = self._table("sums", SUMS, last).withColumns({c: F.col(c) * factor for c in ("used", "shown")})
            own = old.unionByName(own).groupBy("user_id", "doc_id").agg(F.sum("used").alias("used"), F.sum("shown").alias("shown"))
            of = self._table("cells", CELLS, last).unionByName(of).groupBy("user_id", "doc_id", "weekday", "slot").agg(F.sum("n").alias("n"))
        own.write.mode("overwrite").parquet(f"{self.folder}/sums/{version}")
        of.write.mode("overwrite").parquet(f"{self.folder}/cells/{version}")
        self.spark.createDataFrame([(version, float(now))], "version long, as_of double").write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
        for old_version, _ in known[:-1]:
            for name in ("sums", "cells"):
                removed(self.spark, f"{self.folder}/{name}/{old_version}")
        return version

    def _latest(self, name: str, form: str) -> DataFrame:
        known = self.versions()
        return self._table(name, form, known[-1][0]) if known else self.spark.createDataFrame([], form)

    def activity(self, active: DataFrame) -> DataFrame:
        """user_id, doc_id, score and normalised (share of the user's best) of active files."""
        raw = self._latest("sums", SUMS).select("user_id", "doc_id", (F.col("used") + F.col("shown")).alias("score")).join(active.select("doc_id"), "doc_id", "left_semi")
        top = F.max("score").over(Window.partitionBy("user_id"))
        return raw.select("user_id", "doc_id", F.round("score", 6).alias("score"), F.round(F.when(top > 0, F.col("score") / top), 6).alias("normalised"))

    def type_shares(self, records: DataFrame) -> DataFrame:
        """user_id, ext and its share of the decayed weight of uses; inactive files count."""
        by = self._latest("sums", SUMS).where("used > 0").join(records.select("doc_id", "ext"), "doc_id").groupBy("user_id", "ext").agg(F.sum("used").alias("w"))
        return by.select("user_id", "ext", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("user_id")), 6).alias("share"))

    def slot_histogram(self) -> DataFrame:
        return self._latest("cells", CELLS).groupBy("user_id", "weekday", "slot").agg(F.sum("n").alias("n"))
