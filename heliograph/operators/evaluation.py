"""Judged results as metrics, thresholds from distances, and what a router learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.store import newest

# Fixed values.
COMPONENT_WEIGHTS = {"accuracy": 0.35, "reliability": 0.25, "response_time": 0.15, "grounding": 0.15, "resource": 0.10}
SMALL_SAMPLE = 20
NOT_TEXT = ("visual", "ask", "exact")


def latency(rows: DataFrame, ms: str = "ms") -> DataFrame:
    """p50_ms, p95_ms and mean_ms: observed values, the middle one and the one that 95 of 100 don't exceed."""
    line = Window.orderBy(ms)
    # one row for each judged query
    placed = rows.where(F.col(ms).isNotNull()).select(ms, (F.row_number().over(line) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = lambda place: F.max(F.when(F.col("i") == place, F.col(ms)))
    return placed.agg(
        at(F.floor(F.col("n") / 2)).alias("p50_ms"),
        at(F.least(F.col("n") - 1, F.ceil(F.col("n") * 0.95) - 1)).alias("p95_ms"),
        F.round(F.avg(ms), 6).alias("mean_ms"),
    )


def retrieval_quality(ranked: DataFrame) -> DataFrame:
    """queries, recall_5, recall_10, mrr, ndcg_5 from (query_id, rank, relevant, n_relevant): recalls are shares of all
    relevant files."""
    hit = lambda k: F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by = ranked.groupBy("query_id", "n_relevant").agg(
        hit(5).alias("in_5"),
        hit(10).alias("in_10"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= 5), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    mean = lambda c: F.round(F.avg(c), 6)
    return by.where("n_relevant > 0").agg(
        F.count("*").alias("queries"),
        mean(F.col("in_5") / F.col("n_relevant")).alias("recall_5"),
        mean(F.col("in_10") / F.col("n_relevant")).alias("recall_10"),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        mean(F.col("dcg") / ideal).alias("ndcg_5"),
    )


def routing_quality(rows: DataFrame) -> DataFrame:
    """Of routed queries (rank of the first relevant file, n_relevant, in_5, embedded, escalated): shares of first
    places, first five, reciprocal ranks, all relevant files in the first five where there are several, queries that
    needed an embedding, and queries that went on."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.agg(
        F.count("*").alias("queries"),
        share(F.col("rank") == 1).alias("hit_1"),
        share(F.col("rank") <= 5).alias("hit_5"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        share((F.col("n_relevant") < 2) | (F.col("in_5") >= F.col("n_relevant"))).alias("both_5"),
        share(F.col("embedded")).alias("embedded"),
        share(F.col("escalated")).alias("escalated"),
    )


def thresholds(distances: DataFrame) -> DataFrame:
    """cutoff, strong_with_literal, strong_meaning_only, gap from (kind, query_id, distance): each query's best relevant
    and irrelevant distance, and for kind no_answer its best of all. Percentiles lie between observed values."""
    best = distances.groupBy("query_id").pivot("kind", ["relevant", "irrelevant", "no_answer"]).agg(F.min("distance"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    got = best.agg(p("relevant", 0.98).alias("r98"), p("relevant", 0.9).alias("r90"), p("relevant", 0.1).alias("r10"), p("no_answer", 0.6).alias("n60"), p(F.col("irrelevant") - F.col("relevant"), 0.5).alias("apart"))
    return got.select(
        F.round(F.greatest("r98", "n60"), 3).alias("cutoff"),
        F.round(F.col("r90") - 0.05 * (F.col("r90") - F.col("r10")), 3).alias("strong_with_literal"),
        F.round("r90", 3).alias("strong_meaning_only"),
        F.round(F.least(F.greatest(F.col("apart") * 0.25, F.lit(0.02)), F.lit(0.2)), 3).alias("gap"),
    )


def training_queries(events: DataFrame, most: int = 2000) -> DataFrame:
    """query and ts (and user_id, if there is one) of the different text queries among each user's newest (kind, query,
    source, mode, ts, event_id): case and spaces at the ends don't tell queries apart, the newest stands. Imported, visual,
    asked and exact ones don't count."""
    own = newest(events.where("kind = 'query'"), most).withColumn("query", F.trim("query"))
    own = own.where((F.col("query") != "") & F.col("source").isNull() & ~F.coalesce(F.col("mode").isin(*NOT_TEXT), F.lit(False)))
    users = [c for c in ("user_id",) if c in events.columns]
    last = F.struct("ts", "event_id")
    return own.groupBy(*users, F.lower("query").alias("_q")).agg(F.max_by("query", last).alias("query"), F.max("ts").alias("ts")).drop("_q")


def component_score(n: Column, **signals: Column) -> Column:
    """Weighted mean of the signals that were measured, in percent; a sample of fewer than twenty counts for less. Null
    if nothing was measured."""
    have = {k: c for k, c in signals.items() if k in COMPONENT_WEIGHTS}
    total = lambda f: sum((f(k, c) for k, c in have.items()), F.lit(0.0))
    weight = total(lambda k, c: F.when(c.isNotNull(), COMPONENT_WEIGHTS[k]).otherwise(0.0))
    raw = total(lambda k, c: F.coalesce(c, F.lit(0.0)) * COMPONENT_WEIGHTS[k]) / F.nullif(weight, F.lit(0.0)) * 100
    return F.round(raw * F.when(n < SMALL_SAMPLE, 0.5 + 0.5 * n / SMALL_SAMPLE).otherwise(1.0), 1)
