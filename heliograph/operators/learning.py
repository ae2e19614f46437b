"""A learned router: which tier suffices, from queries whose cheapest sufficient tier is known."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources.tables import written

TIERS = {"filename": 0, "keyword": 1, "hybrid": 2, "hybrid+rerank": 3, "none": 9}
CONFIDENCE, LEAST = 0.6, 40
#: Nine features; the tenth, a constant, is the regression's intercept, which isn't penalised.
FEATURES = ("words", "content_words", "unknown_words", "question", "stopword_ratio", "clauses", "filename_coverage", "has_filters", "long")


def scaled(features: DataFrame) -> DataFrame:
    share = lambda c, most: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(most)) / most
    return features.select(
        *[c for c in features.columns if c not in FEATURES],
        share("words", 12).alias("words"),
        share("content_words", 10).alias("content_words"),
        share("unknown_words", 5).alias("unknown_words"),
        F.coalesce(F.col("question").cast("double"), F.lit(0.0)).alias("question"),
        F.coalesce("stopword_ratio", F.lit(0.0)).alias("stopword_ratio"),
        share("clauses", 4).alias("clauses"),
        F.coalesce("filename_coverage", F.lit(0.0)).alias("filename_coverage"),
        F.col("has_filters").cast("double").alias("has_filters"),
        (F.col("words") >= 7).cast("double").alias("long"),
    )


def labels(strong: DataFrame) -> DataFrame:
    """query_id and the cheapest tier with a strong result, from (query_id, tier, strong)."""
    rank = F.create_map(*[F.lit(x) for p in TIERS.items() for x in p])[F.col("tier")]
    best = F.min(F.when(F.col("strong"), F.struct(rank.alias("r"), F.col("tier"))))
    return strong.groupBy("query_id").agg(F.coalesce(best["tier"], F.lit("none")).alias("label"))


FOLDS = 5
WEIGHTS = "version long, tier string, feature string, weight double"
SCORES = "version long, fold int, queries long, learned double, rules double"


def train(features: DataFrame, label: DataFrame, version: int = 1) -> DataFrame:
    """Weights (version, tier, feature, weight) of two logistic regressions on all rows: whether names suffice, and whether
    names or all words do. The feature "" is the intercept; a label that all rows share is an intercept alone."""
    rank = F.create_map(*[F.lit(x) for p in TIERS.items() for x in p])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(scaled(features)).join(label, "query_id").withColumn("r", rank[F.col("label")])
    rows = []
    for tier in ("filename", "keyword"):
        of = data.select("vector", (F.col("r") <= TIERS[tier]).cast("double").alias("label"))
        fitted = LogisticRegression(featuresCol="vector", regParam=0.05, maxIter=200, standardization=False).fit(of)
        rows += [(version, tier, name, float(w)) for name, w in zip(FEATURES, fitted.coefficients, strict=True)]
        rows.append((version, tier, "", max(-50.0, min(50.0, float(fitted.intercept)))))
    return data.sparkSession.createDataFrame(rows, WEIGHTS)


def routed(features: DataFrame, rules: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, tier and ruled (what the rules say) by stored weights, as a column expression."""
    rows = weights.collect()  # two models of ten weights
    chance = {}
    for tier in ("filename", "keyword"):
        own = {r.feature: r.weight for r in rows if r.tier == tier}
        chance[tier] = 1 / (1 + F.exp(-sum((F.col(name) * own[name] for name in FEATURES), F.lit(own[""]))))
    tier = F.when(chance["filename"] >= CONFIDENCE, "filename").when(chance["keyword"] >= CONFIDENCE, "keyword").otherwise("hybrid")
    both = scaled(features).select("query_id", tier.alias("tier")).join(rules.select("query_id", F.col("tier").alias("ruled")), "query_id")
    return both.withColumn("tier", F.when(F.col("ruled") == "metadata", "metadata").otherwise(F.col("tier")))


class LearnedRouter:
    """Stored weights, and what five folds said of them; takes over only if it was right more often than the rules on the
    folds it hadn't seen, over at least forty queries."""

    def __init__(self, weights: DataFrame, scores: DataFrame):
        self.weights, self.scores = weights, scores
        queries, own, ruled = scores.agg(F.sum("queries"), F.sum(F.col("queries") * F.col("learned")), F.sum(F.col("queries") * F.col("rules"))).first()
        self.accuracy = {"queries": queries or 0, "learned": own and own / queries, "rules": ruled and ruled / queries}
        self.active = (queries or 0) >= LEAST and own > ruled

    @classmethod
    def fit(cls, features: DataFrame, label: DataFrame, rules: DataFrame, version: int = 1) -> LearnedRouter:
        """features and rules by query_id, label by query_id; queries without a label aren't learned from. Folds are by a
        hash of query_id, so a query's fold never changes; a fold without queries, or whose rest has none, isn't scored."""
        spark = features.sparkSession
        data = written(features.join(label, "query_id").withColumn("_fold", F.pmod(F.xxhash64("query_id"), F.lit(FOLDS)).cast("int")))
        counts = {r["_fold"]: r["count"] for r in data.groupBy("_fold").count().collect()}
        scores = []
        for fold, n in sorted(counts.items()):
            if n == sum(counts.values()):
                continue
            rest, held = data.where(F.col("_fold") != fold), data.where(F.col("_fold") == fold)
            said = routed(held.drop("label", "_fold"), rules, train(rest.drop("label", "_fold"), rest.select("query_id", "label"))).join(held.select("query_id", "label"), "query_id")
            right = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
            queries, own, ruled = said.agg(F.count("*"), right("tier"), right("ruled")).first()
            if queries:
                scores.append((version, fold, queries, own, ruled))
        weights = train(data.drop("label", "_fold"), data.select("query_id", "label"), version) if counts else spark.createDataFrame([], WEIGHTS)
        return cls(weights, spark.createDataFrame(scores, SCORES))

    def save(self, folder: str) -> None:
        """Scores first, weights last: a version is there once its weights are."""
        version = self.weights.first().version
        self.scores.write.mode("overwrite").parquet(f"{folder}/scores/version={version}")
        self.weights.write.mode("overwrite").parquet(f"{folder}/weights/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LearnedRouter:
        """The newest version in the folder."""
        bare = lambda form: form.split(", ", 1)[1] + ", version long"
        weights = spark.read.schema(bare(WEIGHTS)).parquet(f"{folder}/weights")
        newest = weights.agg(F.max("version")).first()[0]
        scores = spark.read.schema(bare(SCORES)).parquet(f"{folder}/scores")
        return cls(weights.where(F.col("version") == newest), scores.where(F.col("version") == newest))

    def route(self, features: DataFrame, rules: DataFrame) -> DataFrame:
        """query_id and tier: the learned one if it is active, else the rules'."""
        return routed(features, rules, self.weights).select("query_id", "tier") if self.active else rules.select("query_id", "tier")
