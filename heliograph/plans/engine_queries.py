"""Registered queries on the engine as a whole, questions, media emission and the learned router."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograph.config import NOW
from heliograph.fixtures import RECORDS, file_records, index, read, text_queries
from heliograph.operators import collection, media, names, retrieval
from heliograph.operators.learning import LearnedRouter, labels
from heliograph.plans.behaviour_queries import MEDIA, _scores
from heliograph.plans.engine import Engine
from heliograph.plans.questions import answer, parse
from heliograph.sources.tables import shared_folder, written

Q: dict = {}
SQL: dict[str, str] = {}


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ASKED = "(1L, 'type:pdf'), (2L, 'doc 17'), (3L, 'the of and'), (4L, 'zzqx qqzz'), (5L, '\"of the\"'), (6L, 'doc_42.pdf in:src2')"


def _engine(spark, sf) -> Engine:
    return Engine(file_records(spark, sf), index(spark, sf))


@_register("search_auto")
def search_auto(spark, sf):
    """Hand-written and sampled queries through the router, with escalation."""
    asked = spark.sql(f"select * from values {ASKED} as t(query_id, query)").unionByName(text_queries(spark, sf).select((F.col("query_id") + 1000).alias("query_id"), "query"))
    return _engine(spark, sf).search(asked).select("query_id", "doc_id", "path", "tier", "confidence", "rank")


@_register("suggest")
def suggest(spark, sf):
    asked = text_queries(spark, sf).select("query_id", F.replace("query", F.lit("e"), F.lit("ee")).alias("query"))
    return _engine(spark, sf).suggest(asked)


@_register("learned_router")
def learned_router(spark, sf):
    engine, asked = _engine(spark, sf), text_queries(spark, sf)
    parsed = asked.select("query_id", F.col("query").alias("words"), F.lit(None).cast("string").alias("phrase"), F.lit(False).alias("has_filters"))
    features = written(names.route_features(parsed, engine.vocabulary(), names.match_filenames(asked, engine.records)))
    # each tier is replayed: names, all words, half of the words; the cheapest with a strong result counts, or none
    tried = lambda hits, tier: hits.select("query_id", F.lit(tier).alias("tier"), F.lit(True).alias("strong"))
    found = tried(names.match_filenames(asked, engine.records), "filename").unionByName(tried(retrieval.bm25_and(asked, engine.index), "keyword")).unionByName(tried(retrieval.bm25_relaxed(asked, engine.index), "hybrid"))
    missed = asked.select("query_id", F.lit("none").alias("tier"), F.lit(False).alias("strong"))
    label = written(labels(found.unionByName(missed)))
    rules = written(names.route(features))
    folder = f"{shared_folder(spark)}/router-{uuid.uuid4().hex}"
    LearnedRouter.fit(features, label, rules).save(folder)
    return LearnedRouter.load(spark, folder).route(features, rules)


QUESTIONS = {
    1: ("How many PDFs do I have?", "not deleted and ext = 'pdf'", "modified_time desc", 10),
    2: ("how many files are in the src1 folder", "not deleted and path like '%/src1/%'", "modified_time desc", 10),
    3: ("list the 5 oldest photos", "not deleted and ext = 'jpg'", "modified_time asc", 5),
    4: ("show me files changed in the last 2 weeks", f"not deleted and modified_time >= {NOW - 14 * 86400}", "modified_time desc", 10),
    5: ("how many files failed", "not deleted and not indexed", "modified_time desc", 10),
    6: ("do i have videos", "not deleted and ext = 'mp4' and not coalesce(audio_only, false)", "modified_time desc", 10),
    7: ("what did the files say about rivers", None, None, None),
    8: ("the newest file", "not deleted", "modified_time desc", 1),
    9: ("how many files were deleted", "deleted", "modified_time desc", 10),
    10: ("how many audio files last week", f"not deleted and (ext = 'mp3' or coalesce(audio_only, false)) and modified_time >= {1705881600.0} and modified_time < {1706486400.0}", "modified_time desc", 10),
}


@_register("collection_answers", f"with {RECORDS} " + " union all ".join(
    f"select {i}::bigint as question_id, count(*)::bigint as n, coalesce((select string_agg(name, ', ' order by place) from (select regexp_extract(path, '[^/]*$', 0) as name, row_number() over (order by {o}, doc_id) as place from records where {w}) where place <= {k}), '') as examples from records where {w}"
    for i, (_, w, o, k) in QUESTIONS.items() if w))
def collection_answers(spark, sf):
    """Each question as a request over the records; a question about content gives no request."""
    records, out = file_records(spark, sf), None
    for i, (question, *_) in QUESTIONS.items():
        if request := parse(question):
            one = answer(request, records).select(F.lit(i).cast("long").alias("question_id"), "n", "examples")
            out = one if out is None else out.unionByName(one)
    return out


@_register("visual_moments")
def visual_moments(spark, sf):
    frames = _scores(spark, sf).select("query_id", F.floor(F.col("vec_id") / 20).alias("file_id"), (F.col("vec_id") % 20).cast("double").alias("t"), "distance")
    return media.moments(frames)


@_register("visual_shown", f"""with {MEDIA}, b as (select query_id, (vec_id // 4)::bigint as file_id, min(distance) as distance from near group by all),
t as (select *, case when file_id % 5 = 0 then 'video' else 'photo' end as kind, case when distance <= 1.7 then 0 when distance <= 1.9 then 1 end as t0 from b),
a as (select *, row_number() over (partition by query_id, t0 order by distance, file_id) as n from t where t0 is not null),
s as (select *, case when t0 = 0 and n > 10 then 1 else t0 end as tier from a),
k as (select *, row_number() over (partition by query_id, tier, kind order by distance, file_id) as of_kind from s),
f as (select *, row_number() over (partition by query_id, tier order by distance, file_id) as rank from k where tier = 0 or kind <> 'video' or of_kind <= 3)
select query_id, file_id, case when tier = 0 then 'strong' else 'weak' end as tier, rank::bigint as rank from f where tier = 0 or rank <= 12""")
def visual_shown(spark, sf):
    files = collection.best_per_file(_scores(spark, sf).withColumn("file_id", F.floor(F.col("vec_id") / 4)))
    kind = F.when(F.col("file_id") % 5 == 0, "video").otherwise("photo")
    return media.shown(files.select("query_id", "file_id", kind.alias("kind"), "distance", F.lit(1.7).alias("strong"), F.lit(1.9).alias("possible")), 10)


@_register("vector_rows_by_file", "select vec_id, label from embeddings where vec_id // 4 in (3, 7, 11)")
def vector_rows_by_file(spark, sf):
    return read(spark, sf, "embeddings").where(F.floor(F.col("vec_id") / 4).isin(3, 7, 11)).select("vec_id", "label")
