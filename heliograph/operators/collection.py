"""Questions about the collection itself, and checks that an answer rests on its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, NOW, QUESTION_WORDS, STOP_WORDS, TYPE_GROUPS
from heliograph.functions.text import filename, tokens
from heliograph.operators.answers import MONTHS, WEEKDAYS


def summary(records: DataFrame, k: int = 4) -> DataFrame:
    """The most common extensions of live files."""
    return records.where("not deleted").groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(k)


def by_kind(records: DataFrame, examples: int = 3) -> DataFrame:
    """ext, n and the first names of live, indexed files. Counts are combined before the exchange, and of the examples
    each task sends only its first ones."""
    live = records.where("not deleted and indexed")
    line = Window.partitionBy("ext").orderBy("doc_id")
    first = live.select("ext", "doc_id", filename("path").alias("name"), F.row_number().over(line).alias("place")).where(F.col("place") <= examples)
    names = first.groupBy("ext").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "name"))), lambda s: s["name"]), ", ").alias("examples"))
    return live.groupBy("ext").agg(F.count("*").alias("n")).join(names, "ext")


def newest(records: DataFrame, k: int = 10, since: float | None = None) -> DataFrame:
    live = records.where("not deleted")
    if since is not None:
        live = live.where(F.col("modified_time") >= since)
    return live.orderBy(F.desc("modified_time"), "doc_id").limit(k)


def deleted_recently(log: DataFrame, now: float = NOW, window: float = DEFAULTS.recent_s, k: int = 10) -> DataFrame:
    """The latest deletions of the window, at most ten, with the number of all."""
    inside = log.where((F.col("deleted_at") >= now - window) & (F.col("deleted_at") <= now))
    total = inside.agg(F.count("*").alias("total"))
    return inside.orderBy(F.desc("deleted_at"), "doc_id").limit(k).join(F.broadcast(total))  # one row


#: Characters of the longest file name.
LONGEST_NAME = 260


def why_missing(asked: DataFrame, states: DataFrame, indexing: bool = False) -> DataFrame:
    """asked (name) and the state of the file: the first that fits of indexed, failed, skipped, deleted, waiting; else
    invalid, if it is no name; else unsupported, if its extension is of no format that is read; else similar, if one name
    is one edit away; else unknown, or indexing while a scan runs, as what is waiting also is. states: name, tier, state."""
    typed = F.trim("name", F.lit("\"' "))
    invalid = (typed == "") | ~typed.rlike(r"[\p{L}\p{N}]") | typed.rlike(r"[*?\x00]") | (F.length(typed) > LONGEST_NAME)
    ext = F.lower(F.regexp_extract(typed, r"\.([A-Za-z0-9]{1,5})$", 1))
    unread = (ext != "") & ~ext.isin(*{e for group in TYPE_GROUPS.values() for e in group})
    exact = asked.join(states, "name").groupBy("name").agg(F.min_by("state", F.struct("tier", "state")).alias("state"))
    rest = asked.join(exact, "name", "left_anti")
    drops = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))
    known = states.select(F.col("name").alias("other")).distinct().withColumn("key", F.explode(drops("other")))
    near = rest.withColumn("key", F.explode(drops("name"))).join(known, "key").where(F.levenshtein("name", "other", 1) >= 0).select("name", "other").distinct()
    single = near.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name", F.lit("similar").alias("state"))
    other = F.when(invalid, "invalid").when(unread, "unsupported").otherwise(F.coalesce("state", F.lit("indexing" if indexing else "unknown")))
    out = exact.union(rest.join(single, "name", "left").select("name", other.alias("state")))
    return out.withColumn("state", F.when(F.col("state") == "waiting", "indexing" if indexing else "failed").otherwise(F.col("state")))


def grounding(pairs: DataFrame) -> DataFrame:
    """Adds weight, share and supports to (answer, source): answer words that the source has, numbers counting double;
    it supports with a weight of three or half of all."""
    words = F.array_distinct(F.filter(tokens("answer"), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1)))
    value = lambda a: F.aggregate(a, F.lit(0), lambda s, w: s + F.when(w.rlike(r"\d"), 2).otherwise(1))
    out = pairs.withColumn("aw", words).withColumn("met", F.array_intersect("aw", tokens("source")))
    out = out.withColumns({"weight": value(F.col("met")).cast("long"), "all_": value(F.col("aw")).cast("long")})
    share = F.when(F.col("all_") > 0, F.round(F.col("weight") / F.col("all_"), 6)).otherwise(0.0)
    return out.withColumn("share", share).withColumn("supports", (F.col("weight") >= 3) | (F.col("share") >= 0.5)).drop("aw", "met", "all_")


def figures_missing(pairs: DataFrame) -> DataFrame:
    """Adds missing: numbers of the answer that the source hasn't, commas ignored."""
    numbers = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"(\d),(?=\d)", "$1"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return pairs.withColumn("missing", F.array_join(F.array_sort(F.array_except(numbers("answer"), numbers("source"))), ","))


#: Strong sources that offer a sentence, words of a sentence, and question words that it and its file's name must have.
QUICK_SOURCES, QUICK_WORDS, QUICK_OVERLAP = 3, (3, 60), 2


def quick_answer(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """question_id, chunk_id, sentence, score: the sentence of the best three sources that says most of what is asked.

    questions: question_id, question; passages: question_id, chunk_id, content, and if known filename and rank. Question
    words of three letters or more count, also by the beginning of a word: one for each in the sentence, half if the
    file's name has it already or if the sentence only names a file with it, half for each that the name has, half for
    a figure. Months and weekdays that are asked for must be there. Ties go to the better source, then to the earlier
    sentence; nothing is told if no sentence says something that is asked.
    """
    rank = F.col("rank") if "rank" in passages.columns else F.lit(0)
    name = F.lower(F.regexp_replace("filename", r"\.[^.]*$", "")) if "filename" in passages.columns else F.lit("")
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    q = F.filter(words(F.col("question")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS, *QUESTION_WORDS))
    q = F.array_union(q, F.transform(F.filter(q, lambda w: w.endswith("s") & (F.length(w) > 4)), lambda w: F.substr(w, F.lit(1), F.length(w) - 1)))
    line = Window.partitionBy("question_id").orderBy("rank", "chunk_id")
    near = passages.select("question_id", "chunk_id", "content", rank.alias("rank"), name.alias("name")).withColumn("place", F.row_number().over(line)).where(F.col("place") <= QUICK_SOURCES)
    both = near.join(questions.select("question_id", q.alias("q")).where(F.size("q") > 0), "question_id")
    sentence = both.select("*", F.posexplode(F.split("content", r"(?<=[.!?])\s+|\n+")).alias("i", "raw")).withColumn("sentence", F.trim(F.col("raw"), F.lit(" -•\t")))
    begins = lambda held: lambda w: F.exists(held, lambda t: t.startswith(w))
    in_name = words(F.col("name"))
    by_name = F.filter("q", lambda w: F.exists(in_name, lambda n: (F.length(n) >= 3) & (n.startswith(w) | w.startswith(n))))
    own = sentence.withColumns({"said": words(F.col("sentence")), "by_name": by_name, "files": words(F.array_join(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\w.-]+\.[a-z0-9]{2,5}\b"), F.lit(0)), " "))})
    own = own.withColumn("hits", F.filter("q", begins(F.col("said")))).withColumn("half", F.filter("hits", lambda w: F.array_contains("by_name", w) | F.array_contains("files", w)))
    n = F.size(F.split("sentence", r"\s+"))
    dated = F.filter("q", lambda w: w.isin(*MONTHS, *WEEKDAYS))
    fits = n.between(*QUICK_WORDS) & (F.size("hits") > 0) & (F.size(F.array_union("hits", "by_name")) >= F.least(F.lit(QUICK_OVERLAP), F.size("q")))
    fits &= F.forall(dated, lambda w: F.array_contains("hits", w) | F.array_contains("by_name", w))
    score = F.size("hits") - 0.5 * F.size("half") + 0.5 * F.size("by_name") + F.when(F.col("sentence").rlike(r"\d"), 0.5).otherwise(0.0)
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "place", "i")
    return own.where(fits).withColumn("score", score).withColumn("n", F.row_number().over(best)).where("n = 1").select("question_id", "chunk_id", "sentence", "score")


def media_limits(hits: DataFrame, size: int) -> DataFrame:
    """query_id, strong, possible: limits for photo distances (squared L2) from a query's 100 nearest (query_id, distance, rank) and the
    size of the library. With 100 photos or more they follow the best, the 100th and the size; small libraries have fixed ones."""
    by = hits.groupBy("query_id").agg(F.min("distance").alias("best"), F.max(F.when(F.col("rank") == 100, F.col("distance"))).alias("reference")).withColumn("size", F.lit(size))
    root = lambda n: F.sqrt(2 * F.log(n))
    bound = F.when(F.col("size") > 130, F.greatest(F.lit(1.40), 1.51 - 0.05 * (root(F.col("size")) - root(F.lit(130.0))))).otherwise(1.51)
    by = by.withColumn("bound", bound)
    large = F.col("size") >= 100
    strong = F.when(large, F.least("bound", F.col("best") + 0.04, F.col("reference") - 0.07)).otherwise(F.when(F.col("best") <= 1.51, F.greatest(F.lit(1.51), F.least(F.lit(1.53), F.col("best") + 0.08))).otherwise(1.51))
    possible = F.when(large, F.least(F.lit(1.55), F.col("bound") + 0.03, F.col("best") + 0.08, F.col("reference") - 0.04)).otherwise(F.least(F.lit(1.55), F.col("best") + 0.10))
    return by.select("query_id", F.round(strong, 6).alias("strong"), F.round(F.greatest(strong, possible), 6).alias("possible"))


def best_per_file(hits: DataFrame) -> DataFrame:
    """query_id, file_id, vec_id, distance: each file by its nearest frame."""
    best = F.min(F.struct("distance", "vec_id")).alias("b")
    return hits.groupBy("query_id", "file_id").agg(best).select("query_id", "file_id", "b.vec_id", "b.distance")
