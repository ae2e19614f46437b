"""From ranked lists to results: fusion, aggregation to files, confidence, personal order, explanations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, PERSONAL_MIX, Settings


def rrf(keyword: DataFrame, semantic: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, chunk_id, doc_id, fused: the sum of 1 / (60 + rank) over both lists; keeps both scores and ranks."""
    kw = keyword.select("query_id", "chunk_id", "doc_id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    sem = semantic.select("query_id", "chunk_id", "doc_id", "distance", F.col("rank").alias("semantic_rank"))
    part = lambda c: F.coalesce(1.0 / (s.rrf_k + F.col(c)), F.lit(0.0))
    return kw.join(sem, ["query_id", "chunk_id", "doc_id"], "full_outer").withColumn("fused", F.round(part("keyword_rank") + part("semantic_rank"), 9))


def promote(hits: DataFrame, logits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds promoted: 1 + logit / 1000 for the ten best fused chunks whose logit is positive; nothing is demoted."""
    line = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank"), "chunk_id")
    placed = hits.withColumn("place", F.row_number().over(line)).join(logits, ["query_id", "chunk_id"], "left")
    return placed.withColumn("promoted", F.when((F.col("place") <= s.rerank_top) & (F.col("logit") > 0), F.round(s.promotion + F.col("logit") / 1000, 9))).drop("place")


def to_files(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, doc_id, score, chunk_id, keyword_score, distance: the best chunk, plus a hundredth of the fused scores
    of the next two; never a mean."""
    best = F.greatest("fused", F.coalesce("promoted", F.lit(0.0))) if "promoted" in hits.columns else F.col("fused")
    line = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("best"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank"), "chunk_id")
    placed = hits.withColumn("best", best).withColumn("n", F.row_number().over(line))
    more = F.sum(F.when(F.col("n").between(2, 1 + s.secondary_chunks), F.col("fused")).otherwise(0.0))
    return placed.groupBy("query_id", "doc_id").agg(
        F.round(F.max("best") + s.secondary_weight * more, 9).alias("score"),
        F.max(F.when(F.col("n") == 1, F.col("chunk_id"))).alias("chunk_id"),
        F.max("keyword_score").alias("keyword_score"),
        F.min("distance").alias("distance"),
    )


def confidence(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds confidence. A literal match is strong. A match by meaning alone is strong within the threshold (a tighter
    one beside literal matches) or near the best of its kind; the best is taken over the results given here."""
    query = Window.partitionBy("query_id")
    literal = F.col("keyword_score").isNotNull()
    any_literal = F.bool_or(literal).over(query)
    best = F.min(F.when(~literal, F.col("distance"))).over(query)
    limit = F.when(any_literal, s.strong_with_literal).otherwise(s.strong_meaning_only)
    strong = literal | (F.col("distance") <= limit) | ((best <= limit) & (F.col("distance") <= best + s.strong_gap))
    return files.withColumn("confidence", F.when(F.coalesce(strong, F.lit(False)), "strong").otherwise("weak"))


def prune(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Beside strong results, a weak one stays only near the best strong distance, and at most three do. Strong first."""
    query = Window.partitionBy("query_id")
    strong = F.col("confidence") == "strong"
    any_strong, best = F.bool_or(strong).over(query), F.min(F.when(strong, F.col("distance"))).over(query)
    near = files.withColumn("stays", F.when(strong | ~any_strong, True).otherwise(F.coalesce(F.col("distance") <= best + s.weak_gap, F.lit(False)))).where("stays")
    line = Window.partitionBy("query_id", "confidence").orderBy(F.desc("score"), "doc_id")
    kept = near.withColumn("n", F.row_number().over(line)).where((F.col("confidence") == "strong") | (F.col("n") <= s.weak_shown))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("confidence") == "strong", 0).otherwise(1), F.desc("score"), "doc_id")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).drop("stays", "n")


def personal_boost(signals: DataFrame) -> DataFrame:
    """Adds boost from the signals frequency, recency, type, topic and time; a missing signal is 0."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in PERSONAL_MIX.items()), F.lit(0.0))
    return signals.withColumn("boost", F.round(total, 8))


def personal_reasons(signals: DataFrame) -> DataFrame:
    """The two strongest signals that are strong enough to be told."""
    least = {"frequency": 0.25, "recency": 0.5, "type": 0.5, "topic": 0.6, "time": 0.5}
    each = F.array(*(F.when(F.coalesce(F.col(c), F.lit(0.0)) >= v, F.struct((-F.col(c)).alias("strength"), F.lit(c).alias("name"))) for c, v in least.items()))
    told = F.slice(F.array_sort(F.filter(each, lambda x: x.isNotNull())), 1, 2)
    return signals.withColumn("reasons", F.array_join(F.transform(told, lambda x: x["name"]), ","))


def near_ties(results: DataFrame, window: float = DEFAULTS.tie_window, jaccard: float = DEFAULTS.duplicate_jaccard) -> DataFrame:
    """Reorders results (query_id, doc_id, rank, band, score, boost, tokens) by boost within near ties.

    A tie is a run in one band whose scores are within the window of its first; within it near-duplicates (Jaccard of
    their tokens with the first of a cluster) stay together, clusters and members by boost. Greedy and sequential, so
    a grouped pandas function; a query has at most a page of results.
    """

    def each(pages: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        rows = pages.sort_values("rank").to_dict("records")
        out, i = [], 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j]["band"] == rows[i]["band"] and rows[i]["score"] - rows[j]["score"] <= window:
                j += 1
            clusters: list[list[dict]] = []
            for r in rows[i:j]:
                own = set(r["tokens"])
                for c in clusters:
                    head = set(c[0]["tokens"])
                    if own | head and len(own & head) / len(own | head) >= jaccard:
                        c.append(r)
                        break
                else:
                    clusters.append([r])
            clusters = [sorted(c, key=lambda r: (-r["boost"], r["rank"])) for c in clusters]
            clusters.sort(key=lambda c: (-c[0]["boost"], min(r["rank"] for r in c)))
            out += [r for c in clusters for r in c]
            i = j
        return pd.DataFrame([{"query_id": r["query_id"], "doc_id": r["doc_id"], "rank": n, "was": r["rank"]} for n, r in enumerate(out, 1)], columns=["query_id", "doc_id", "rank", "was"])

    return results.groupBy("query_id").applyInPandas(each, "query_id long, doc_id long, rank long, was long")


def explain(files: DataFrame) -> DataFrame:
    """Adds why: which words, or that the meaning fits; and where (section, heading, page or slide). A file with a literal match
    whose best passage is known by its meaning only (matched is null) is told as one without words."""
    literal = F.col("keyword_score").isNotNull()
    place = F.when(F.col("path").endswith(".pptx"), F.concat(F.lit("Slide "), F.col("page_number"))).otherwise(F.concat(F.lit("Page "), F.col("page_number")))
    said = F.array(F.when(literal, F.concat(F.lit("Contains: "), F.coalesce(F.array_join("matched", ", "), F.lit("")))).otherwise(F.lit("Meaning matches")), F.when(F.col("page_number").isNotNull(), place))
    return files.withColumn("why", F.array_compact(said))


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """recall_5, mrr, ndcg_5 over queries from (query_id, rank, relevant, n_relevant)."""
    gain = F.when(F.col("relevant") & (F.col("rank") <= 5), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by = ranked.groupBy("query_id", "n_relevant").agg(
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= 5), 1).otherwise(0)).alias("in_5"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"),
    )
    return by.withColumn("ideal", best).agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("in_5") / F.least(F.col("n_relevant"), F.lit(5))), 6).alias("recall_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("dcg") / F.col("ideal")), 6).alias("ndcg_5"),
    )
