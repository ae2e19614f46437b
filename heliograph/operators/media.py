"""Photos and videos: distinct moments of a clip, and how many results of each tier are shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTS, APART_S, WITHIN = 3, 3.0, 0.10
STRONG_SHOWN, POSSIBLE_SHOWN, POSSIBLE_VIDEOS = 16, 12, 3


def moments(frames: DataFrame) -> DataFrame:
    """query_id, file_id, moment, t, distance: up to three frames of each file, nearest first, at least three seconds
    apart and nearly as near as the best. Greedy, so a grouped pandas function over the frames of one file."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[float, float]] = []
        for r in rows.sort_values(["distance", "t"]).itertuples():
            if taken and r.distance > taken[0][1] + WITHIN or len(taken) == MOMENTS:
                break
            if all(abs(r.t - t) >= APART_S for t, _ in taken):
                taken.append((r.t, r.distance))
        return pd.DataFrame([(rows["query_id"].iat[0], rows["file_id"].iat[0], n, t, d) for n, (t, d) in enumerate(taken, 1)], columns=["query_id", "file_id", "moment", "t", "distance"])

    return frames.groupBy("query_id", "file_id").applyInPandas(each, "query_id long, file_id long, moment long, t double, distance double")


def shown(files: DataFrame, k: int) -> DataFrame:
    """files (query_id, file_id, kind, distance, strong, possible) that are shown, with tier: strong ones up to 16 and
    up to k; what is beyond them and possible ones as weak, at most 12, of them three videos."""
    tier = F.when(F.col("distance") <= F.col("strong"), 0).when(F.col("distance") <= F.col("possible"), 1)
    near = files.withColumn("tier", tier).where("tier is not null")
    line = Window.partitionBy("query_id", "tier").orderBy("distance", "file_id")
    near = near.withColumn("n", F.row_number().over(line)).withColumn("tier", F.when((F.col("tier") == 0) & (F.col("n") > min(STRONG_SHOWN, k)), 1).otherwise(F.col("tier")))
    kinds = Window.partitionBy("query_id", "tier", "kind").orderBy("distance", "file_id")
    near = near.withColumn("of_kind", F.row_number().over(kinds)).where((F.col("tier") == 0) | (F.col("kind") != "video") | (F.col("of_kind") <= POSSIBLE_VIDEOS))
    near = near.withColumn("n", F.row_number().over(line)).where((F.col("tier") == 0) | (F.col("n") <= POSSIBLE_SHOWN))
    return near.select("query_id", "file_id", F.when(F.col("tier") == 0, "strong").otherwise("weak").alias("tier"), F.col("n").cast("long").alias("rank"))
