"""Access methods: BM25 and phrases by the stored index, snippets, passages and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS
from heliograph.functions.text import tokens
from heliograph.operators.index import KeywordIndex
from heliograph.sources.tables import written


def top(hits: DataFrame, k: int, score: str, descending: bool = True) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(score) if descending else F.asc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def vocabulary(chunks: DataFrame, least: int = 3) -> DataFrame:
    """term and its occurrences, for terms of at least three characters; of chunks that are in no index."""
    return chunks.select(F.explode(tokens("content")).alias("term")).where(F.length("term") >= least).groupBy("term").agg(F.count("*").alias("occurrences"))


def bm25_and(queries: DataFrame, index: KeywordIndex, k: int = DEFAULTS.hits, scope: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, score, rank of chunks with every word of the query."""
    return top(index.search(queries, "all", k, scope), k, "score").drop("places")


def bm25_relaxed(queries: DataFrame, index: KeywordIndex, k: int = DEFAULTS.hits, scope: DataFrame | None = None) -> DataFrame:
    """Chunks with at least half of the words."""
    return top(index.search(queries, "half", k, scope), k, "score").drop("places")


def phrase_match(queries: DataFrame, index: KeywordIndex, scope: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, score, places of all chunks in which the query's words stand one after another."""
    return index.search(queries, "phrase", None, scope)


def highlight(hits: DataFrame, words: str = "word", content: str = "content") -> DataFrame:
    """Adds snippet: twenty words from just before the first match, matches in asterisks, dots where text is cut."""
    every = F.split(content, " ")
    first = F.array_position(F.transform(every, lambda w: F.array_contains(tokens(w), F.col(words))), True)
    start = F.greatest(first.cast("int") - 5, F.lit(1))
    marked = F.transform(F.slice(every, start, 20), lambda w: F.when(F.array_contains(tokens(w), F.col(words)), F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w))
    return hits.withColumn("snippet", F.when(first > 0, F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(F.size(every) > start + 19, "...").otherwise(""))))


def best_window(every: Column, words: Column) -> Column:
    """first and last piece (from 1) of the shortest stretch of a split text that holds as many different words as the text
    does, the earliest of such; null without any. One pass over the places of all words, which keeps the latest of each."""
    met = F.transform(every, lambda piece, i: F.transform(F.array_intersect(tokens(piece), words), lambda w: F.struct((i + 1).alias("i"), w.alias("word"))))
    place = "struct<i:int,word:string>"
    start = F.struct(F.array().cast(f"array<{place}>").alias("latest"), F.lit(None).cast("struct<few:int,width:int,first:int>").alias("best"))

    def step(state: Column, p: Column) -> Column:
        latest = F.concat(F.filter(state["latest"], lambda x: x["word"] != p["word"]), F.array(p))
        first = F.array_min(F.transform(latest, lambda x: x["i"]))
        own = F.struct((-F.size(latest)).alias("few"), (p["i"] - first).alias("width"), first.alias("first"))
        return F.struct(latest.alias("latest"), F.when(state["best"].isNull() | (own < state["best"]), own).otherwise(state["best"]).alias("best"))

    best = F.aggregate(F.flatten(met), start, step)["best"]
    return F.when(best.isNotNull(), F.struct(best["first"].alias("first"), (best["first"] + best["width"]).alias("last")))


def snippets(hits: DataFrame, words: str = "words", content: str = "content") -> DataFrame:
    """Adds snippet: twenty words from just before the shortest stretch with most of the words asked for (an array of folded
    ones), these in asterisks, dots where text is cut; null if none is there."""
    every = F.split(content, " ")
    found = hits.withColumn("_window", best_window(every, F.col(words)))
    start = F.greatest(F.col("_window.first") - 5, F.lit(1))
    marked = F.transform(F.slice(every, start, 20), lambda w: F.when(F.arrays_overlap(tokens(w), F.col(words)), F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w))
    snippet = F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(F.size(every) > start + 19, "...").otherwise(""))
    return found.withColumn("snippet", F.when(F.col("_window").isNotNull(), snippet)).drop("_window")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Queries that one pass over the vectors answers; more are answered in several.
KNN_BLOCK = 4096


def _compared(queries: DataFrame, vectors: DataFrame, pick, form: str) -> DataFrame:
    """Stated queries (query_id, query_vec and what else belongs to them) against all vectors (a key, embedding and what
    else belongs to them): pick(asked, rows, apart) makes a batch of results from columns of some queries, columns of a batch of
    vectors in the order of their keys, and the squared distances between them. A block of queries is sent to all tasks."""
    asked = queries.where("query_vec is not null")
    blocks = max(1, -(-asked.count() // KNN_BLOCK))
    names, out = vectors.columns, None
    for b in range(blocks):
        block = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow()  # of the stated queries
        lines = np.array(block["query_vec"].to_pylist(), np.float64)
        own = {c: block[c].to_numpy() for c in block.column_names if c != "query_vec"}

        def each(batches: Iterator[pa.RecordBatch], lines: np.ndarray = lines, own: dict[str, np.ndarray] = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(lines) or not batch.num_rows:
                    continue
                vecs = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
                rows = {c: batch.column(k).to_numpy(zero_copy_only=False)[order] for k, c in enumerate(names) if k != 1}
                vecs = vecs[order]
                for at in range(0, len(lines), 256):
                    some = lines[at : at + 256]
                    apart = np.maximum((some**2).sum(1)[:, None] + (vecs**2).sum(1) - 2 * some @ vecs.T, 0).round(6)
                    yield pick({c: v[at : at + 256] for c, v in own.items()}, rows, apart)

        key, vec, *more = names
        hits = vectors.where(F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>"), *more).mapInArrow(each, form)
        out = hits if out is None else out.unionByName(hits)
    return out


def _nearest(apart: np.ndarray, k: int) -> np.ndarray:
    """Whether each distance is among the k smallest of its row, or equal to the last of these."""
    return apart <= np.partition(apart, k - 1, axis=1)[:, k - 1 : k] if apart.shape[1] > k else np.full(apart.shape, True)


def knn(queries: DataFrame, vectors: DataFrame, k: int | None = DEFAULTS.hits, cutoff: float | None = None, key: str = "vec_id") -> DataFrame:
    """query_id, key, distance (squared L2, six places), rank: the stated queries against all vectors, each batch of
    vectors by a matrix product with a block of queries. Filters on vectors stand before. A batch sends its k best of
    each query on (all within the cutoff if k is None, without rank); ties go to the smaller key.

    queries: query_id, query_vec; vectors: key and embedding, of one width. A null vector takes no part.
    """
    if k is None and cutoff is None:
        raise ValueError("all pairs aren't told: give a number or a cutoff")
    of_key = vectors.select(key).schema[0].dataType.simpleString()

    def pick(asked: dict, rows: dict, apart: np.ndarray) -> pa.RecordBatch:
        good = np.full(apart.shape, True) if cutoff is None else apart <= cutoff
        q, v = np.nonzero(good if k is None else good & _nearest(apart, k))
        return pa.RecordBatch.from_arrays([pa.array(asked["query_id"][q]), pa.array(rows[key][v]), pa.array(apart[q, v])], ["query_id", key, "distance"])

    out = _compared(queries.select("query_id", "query_vec"), vectors.select(key, "embedding"), pick, f"query_id long, `{key}` {of_key}, distance double")
    if k is None:
        return out
    best = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", key, "distance", "rank")


def nearest_of_groups(queries: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """query_id, group, vec_id, distance: the nearest vector of every group (a file's frames) to each stated query, ties to the
    smaller vec_id. A batch of vectors sends one row of each query and group on, so no row is made for a pair.

    queries: query_id, query_vec; vectors: vec_id, embedding and the group."""

    def pick(asked: dict, rows: dict, apart: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(rows[group], kind="stable")  # vec_ids ascend within each group
        starts = np.flatnonzero(np.r_[True, np.diff(rows[group][order]) != 0])
        apart = apart[:, order]
        least = np.minimum.reduceat(apart, starts, axis=1)
        met = apart == np.repeat(least, np.diff(np.r_[starts, len(order)]), axis=1)
        first = order[np.minimum.reduceat(np.where(met, np.arange(len(order)), len(order)), starts, axis=1)]
        n = len(starts)
        columns = [np.repeat(asked["query_id"], n), np.tile(rows[group][order[starts]], len(apart)), rows["vec_id"][first].ravel(), least.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", group, "vec_id", "distance"])

    named = vectors.select("vec_id", "embedding", F.col(group).cast("long").alias(group))
    out = _compared(queries.select("query_id", "query_vec"), named, pick, f"query_id long, `{group}` long, vec_id long, distance double")
    best = F.min(F.struct("distance", "vec_id")).alias("b")
    return out.groupBy("query_id", group).agg(best).select("query_id", group, "b.vec_id", "b.distance")


def judged(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, distance, rank, relevant and n_relevant of each query's k nearest vectors, of the nearest relevant and of the
    nearest other one, whatever their ranks: what metrics and thresholds need, without a row for each pair.

    queries: query_id, query_vec, own; vectors: vec_id, embedding, label, may. Relevant is a vector that may be and whose label
    is the query's own; the vector with the query's id isn't compared. A batch of vectors sends k rows of each query on, the nearest of either
    kind and a count. Ranks beyond k come from a second pass that only counts what is nearer.
    """
    form = "query_id long, vec_id long, distance double, relevant boolean, n long"

    def pick(asked: dict, rows: dict, apart: np.ndarray) -> pa.RecordBatch:
        other = asked["query_id"][:, None] != rows["vec_id"]
        apart = np.where(other, apart, np.inf)
        relevant = (asked["own"][:, None] == rows["label"]) & rows["may"].astype(bool) & other
        good = _nearest(apart, k)
        for kind in (relevant, ~relevant):
            of_kind = np.where(kind, apart, np.inf)
            good[np.arange(len(apart)), of_kind.argmin(1)] = True
        q, v = np.nonzero(good & other)
        n = len(apart)
        columns = [np.r_[asked["query_id"][q], asked["query_id"]], np.r_[rows["vec_id"][v], np.zeros(n, np.int64)], np.r_[apart[q, v], np.zeros(n)], np.r_[relevant[q, v], np.zeros(n, bool)], np.r_[np.zeros(len(q), np.int64), relevant.sum(1)]]
        none, count = np.r_[np.zeros(len(q), bool), np.ones(n, bool)], np.r_[np.ones(len(q), bool), np.zeros(n, bool)]
        masks = [None, none, none, none, count]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks, strict=True)], ["query_id", "vec_id", "distance", "relevant", "n"])

    raw = written(_compared(queries.select("query_id", "query_vec", "own"), vectors.select("vec_id", "embedding", "label", F.coalesce("may", F.lit(False)).alias("may")), pick, form))
    counts = raw.where("vec_id is null").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    line = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    hits = raw.where("vec_id is not null").drop("n").withColumn("rank", F.row_number().over(line).cast("long"))
    kind = Window.partitionBy("query_id", "relevant").orderBy("distance", "vec_id")
    hits = written(hits.withColumn("of_kind", F.row_number().over(kind)).where((F.col("rank") <= k) | (F.col("of_kind") == 1)).drop("of_kind"))

    def nearer(asked: dict, rows: dict, apart: np.ndarray) -> pa.RecordBatch:
        line, name = asked["distance"][:, None], asked["vec_id"][:, None]
        before = ((apart < line) | (apart == line) & (rows["vec_id"] < name)) & (asked["query_id"][:, None] != rows["vec_id"])
        return pa.RecordBatch.from_arrays([pa.array(asked["query_id"]), pa.array(asked["vec_id"]), pa.array(before.sum(1))], ["query_id", "vec_id", "n"])

    far = hits.where(F.col("rank") > k)
    places = _compared(far.join(queries.select("query_id", "query_vec"), "query_id"), vectors.select("vec_id", "embedding"), nearer, "query_id long, vec_id long, n long")
    places = places.groupBy("query_id", "vec_id").agg((F.sum("n") + 1).alias("place"))
    ranked = hits.join(places, ["query_id", "vec_id"], "left").withColumn("rank", F.coalesce("place", "rank")).drop("place")
    return ranked.join(counts, "query_id")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector of each key, scaled to length one; null if it is zero."""
    means = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = Window.partitionBy(key)
    return means.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(norm))).select(key, F.col("i").cast("long").alias("i"), F.when(F.col("norm") > 0, F.round(F.col("x") / F.col("norm"), 6)).alias("x"))


def filled(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """hits with what they lack (page, heading, section) taken from their chunks."""
    own = [c for c in chunks.columns if c != key]
    held = hits.join(chunks.select(key, *(F.col(c).alias(f"_{c}") for c in own)), key, "left")
    return held.select(*(F.coalesce(c, f"_{c}").alias(c) if c in own else F.col(c) for c in hits.columns), *(F.col(f"_{c}").alias(c) for c in own if c not in hits.columns))


def first_of(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """Matches of the corrected words, and those of the words as typed that they haven't found."""
    return preferred.unionByName(other.join(preferred.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select(preferred.columns))


def passage_neighbours(chunks: DataFrame) -> DataFrame:
    """Each passage with the one before, the one after and their number in the file."""
    line = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.select("chunk_id", F.lag("chunk_id").over(line).alias("previous"), F.lead("chunk_id").over(line).alias("next"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"))


def file_text(chunks: DataFrame, most: int = 20_000) -> DataFrame:
    """Chunks of a file joined by empty lines, cut at `most` characters, and whether it was cut."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n")
    return chunks.groupBy("doc_id").agg(whole.alias("text")).select("doc_id", F.substring("text", 1, most).alias("text"), (F.length("text") > most).alias("truncated"))


def first_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"), F.min_by("content", "chunk_index").alias("content"))
