"""The search engine: batches of queries against a collection, each by the cheapest plan that should do."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, Settings
from heliograph.functions.text import filename, name_tokens, tidy_query
from heliograph.operators import filters, names, ranking, retrieval
from heliograph.operators.index import KeywordIndex
from heliograph.sources.tables import written

MODES = ("auto", "exact", "keyword", "smart")


@dataclass
class Engine:
    """records: doc_id, path, ext, size, modified_time, deleted, audio_only. index: the keyword index of their chunks.
    vectors: chunk_id, doc_id, embedding (optional). A caller's query vectors (query_id, query_vec) turn the search by
    meaning on; logits (query_id, chunk_id, logit) of a re-ranker may be given too. roots (root) and a listing (path) of
    what is on disk restrict the collection to files under a watched root that are still there."""

    records: DataFrame
    index: KeywordIndex
    vectors: DataFrame | None = None
    settings: Settings = DEFAULTS
    roots: DataFrame | None = None
    listing: DataFrame | None = None

    def live(self) -> DataFrame:
        """The records that a search may return."""
        out = self.records.where("not deleted")
        if self.roots is not None:
            out = filters.contained(out, self.roots)
        if self.listing is not None:
            out = out.join(self.listing.select("path").distinct(), "path", "left_semi")
        return out

    def vocabulary(self) -> DataFrame:
        own = self.records.select(F.explode(name_tokens("path")).alias("term")).where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("occurrences"))
        every = self.index.vocabulary().unionByName(own).groupBy("term").agg(F.sum("occurrences").alias("occurrences"))
        return written(every)  # used several times by routing and spelling

    def suggest(self, queries: DataFrame) -> DataFrame:
        """query_id and suggestion where correcting and tidying change a query; not for phrases."""
        plain = queries.where(~F.col("query").rlike(r'^\s*".*"\s*$'))
        done = names.correct_queries(plain, self.vocabulary()).select("query_id", tidy_query("corrected").alias("suggestion"))
        return plain.join(done, "query_id").where("suggestion <> query").select("query_id", "suggestion")

    def routes(self, queries: DataFrame, mode: str = "auto") -> DataFrame:
        """query_id, tier, complexity and the parsed query."""
        parsed = written(filters.parse_queries(queries))
        set_ = [F.col(c).isNotNull() for c in ("file_type", "after", "before", "size_min", "size_max", "path_contains")]
        parsed = parsed.withColumn("has_filters", reduce(or_, set_))
        if mode != "auto":
            tier = {"exact": "keyword", "keyword": "keyword", "smart": "hybrid"}[mode]
            return parsed.withColumn("tier", F.when((F.col("words") == "") & F.col("has_filters"), "metadata").otherwise(tier)).withColumn("complexity", F.lit(1).cast("long"))
        named = names.match_filenames(parsed.select("query_id", F.col("words").alias("query")), self.records)
        return parsed.join(names.route(names.route_features(parsed, self.vocabulary(), named)), "query_id")

    def _by_words(self, asked: DataFrame, scope: DataFrame, k: int | None) -> DataFrame:
        """All words; where nothing has them, half of them. Phrases as such: chunks that hold the words in order."""
        words = asked.where("phrase is null and words <> ''").select("query_id", F.col("words").alias("query"))
        every = written(self.index.search(words, "all", k, scope))
        missed = words.join(every, "query_id", "left_anti")
        phrase = asked.where("phrase is not null").select("query_id", F.col("phrase").alias("query"))
        return every.unionByName(self.index.search(missed, "half", k, scope)).unionByName(self.index.search(phrase, "phrase", k, scope))

    def _keyword_hits(self, asked: DataFrame, allowed: DataFrame, scope: DataFrame) -> DataFrame:
        """The best chunks by words within what each query may return: filters stand before the ranks."""
        free = self._by_words(asked.where("not has_filters"), scope, self.settings.hits)
        narrow = self._by_words(asked.where("has_filters"), scope, None).join(allowed.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        return retrieval.top(free.unionByName(narrow.select(free.columns)), self.settings.hits, "score")

    def _semantic_hits(self, asked: DataFrame, allowed: DataFrame, scope: DataFrame, query_vecs: DataFrame | None) -> DataFrame | None:
        """The nearest chunks within the cutoff and within what each query may return; not for phrases."""
        if query_vecs is None or self.vectors is None:
            return None
        s, own = self.settings, self.vectors.join(scope, "doc_id", "left_semi")
        lines = query_vecs.join(asked.where("phrase is null").select("query_id", "has_filters"), "query_id")
        near = lambda some, k: retrieval.knn(some, own, k, s.cutoff, "chunk_id").select("query_id", "chunk_id", "distance").join(own.select("chunk_id", "doc_id"), "chunk_id")
        narrow = near(lines.where("has_filters"), None).join(allowed.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        hits = near(lines.where("not has_filters"), s.hits)
        return retrieval.top(hits.unionByName(narrow.select(hits.columns)), s.hits, "distance", descending=False)

    def _content(self, keyword: DataFrame, semantic: DataFrame | None, logits: DataFrame | None) -> DataFrame:
        """Files by content: fused, aggregated and tiered, not pruned yet."""
        if semantic is None:
            semantic = keyword.select("query_id", "chunk_id", "doc_id", F.lit(0.0).alias("distance"), "rank").where("false")
        hits = ranking.rrf(keyword, semantic, self.settings)
        if logits is not None:
            hits = ranking.promote(hits, logits, self.settings)
        return ranking.confidence(ranking.to_files(hits, self.settings), self.settings)

    def search(self, queries: DataFrame, mode: str = "auto", k: int = 10, query_vecs: DataFrame | None = None, logits: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, path, rank, confidence, score, chunk_id, coverage, tier of queries (query_id, query).

        Each query runs in its tier. In auto mode one without a strong result goes on once, to the next tier: from
        filename to keyword, from keyword to hybrid, from hybrid to hybrid+rerank (which needs logits); phrases don't. k is kept between 1 and
        100. What several tiers use (of stated queries, so small beside the collection) is written.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        k = max(1, min(k, 100))
        if mode == "exact":
            quoted = F.when(F.col("query").contains('"'), F.col("query")).otherwise(F.concat(F.lit('"'), F.col("query"), F.lit('"')))
            queries = queries.withColumn("query", quoted)
        none = lambda kind: F.lit(None).cast(kind)
        routed = written(self.routes(queries, mode))
        live = written(self.live())
        scope = live.select("doc_id")
        narrowed = routed.where("has_filters")
        allowed = written(filters.matching(live, narrowed).select("query_id", "doc_id", "path", "modified_time"))
        inside = lambda hits: hits.join(narrowed.select("query_id"), "query_id", "left_anti").unionByName(hits.join(allowed.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select(hits.columns))
        plain = routed.where("phrase is null and tier <> 'metadata'").select("query_id", F.col("words").alias("query"))
        named = written(inside(names.match_filenames(plain, live)))

        # filename -> keyword: queries whose names match nothing after all
        met = named.select("query_id").distinct().withColumn("named", F.lit(True))
        steps = routed.join(met, "query_id", "left").withColumn("tier", F.when((F.col("tier") == "filename") & F.col("named").isNull(), "keyword*").otherwise(F.col("tier"))).drop("named")
        asked = written(steps.where(F.col("tier").isin("keyword", "keyword*", "hybrid")))
        hits = written(self._keyword_hits(asked, allowed, scope))
        by_words = written(self._content(hits, None, None))
        strong_by = lambda files: files.where("confidence = 'strong'").select("query_id").union(named.select("query_id")).distinct().withColumn("strong", F.lit(True))
        onward = F.col("strong").isNull() & F.col("phrase").isNull() & F.lit(mode == "auto")
        # keyword -> hybrid
        step = F.when((F.col("tier") == "keyword") & onward, "hybrid*").otherwise(F.col("tier"))
        second = written(asked.join(strong_by(by_words), "query_id", "left").withColumn("tier", step).drop("strong"))
        deep = second.where(F.col("tier").isin("hybrid", "hybrid*"))
        near = self._semantic_hits(deep, allowed, scope, query_vecs)
        near = None if near is None else written(near)
        of = lambda rows, some: rows.join(some.select("query_id"), "query_id", "left_semi")
        full = written(self._content(of(hits, deep), near, None))
        # hybrid -> hybrid+rerank, if a re-ranker has spoken
        final = second.join(strong_by(full), "query_id", "left").withColumn("tier", F.when((F.col("tier") == "hybrid") & onward & F.lit(logits is not None), "hybrid+rerank").otherwise(F.regexp_replace("tier", r"\*", "")))
        final = written(final.select("query_id", "tier"))
        again = final.where("tier = 'hybrid+rerank'")
        parts = [of(by_words, final.where("tier = 'keyword'")), of(full, final.where("tier = 'hybrid'"))]
        if logits is not None:
            parts.append(self._content(of(hits, again), None if near is None else of(near, again), logits))
        every = reduce(DataFrame.unionByName, parts)
        content = ranking.prune(every, self.settings).join(final, "query_id").join(named.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")

        tiers = steps.where("tier in ('filename')").select("query_id", "tier").unionByName(final.select("query_id", "tier"))
        first = named.join(tiers, "query_id").select("query_id", "doc_id", "tier", none("double").alias("score"), none("string").alias("chunk_id"), F.lit("strong").alias("confidence"), "coverage", "matched", F.lower(filename("path")).alias("name"))
        rest = content.select("query_id", "doc_id", "tier", "score", "chunk_id", "confidence", none("double").alias("coverage"), none("long").alias("matched"), none("string").alias("name"))
        band = F.when(F.col("coverage").isNotNull(), 0).when(F.col("confidence") == "strong", 1).otherwise(2)
        line = Window.partitionBy("query_id").orderBy(band, F.desc_nulls_last("coverage"), F.desc_nulls_last("matched"), F.asc_nulls_last("name"), F.desc_nulls_last("score"), "doc_id")
        ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= k).drop("matched", "name")
        listed = filters.newest(allowed.join(routed.where("tier = 'metadata'").select("query_id"), "query_id", "left_semi"), k)
        listed = listed.select("query_id", "doc_id", F.lit("metadata").alias("tier"), none("double").alias("score"), none("string").alias("chunk_id"), F.lit("strong").alias("confidence"), none("double").alias("coverage"), "rank")
        return ranked.unionByName(listed).join(self.records.select("doc_id", "path"), "doc_id")

    def passages(self) -> DataFrame:
        return retrieval.passage_neighbours(self.index.chunks())

    def file_text(self) -> DataFrame:
        return retrieval.file_text(self.index.chunks())
