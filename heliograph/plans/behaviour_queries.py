"""Registered queries on events, the indexing lifecycle, the collection and media, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import NOW, STOP_WORDS
from heliograph.fixtures import CHUNKS, RECORDS, USAGE, chunks, file_records, index, read, tokens_sql, usage_events
from heliograph.functions import text as T
from heliograph.operators import behaviour as B
from heliograph.operators import collection as C
from heliograph.operators import lifecycle as Y
from heliograph.operators import retrieval as R
from heliograph.operators.profile import Profile
from heliograph.sources.tables import shared_folder

Q: dict = {}
SQL: dict[str, str] = {}
GAP = 12 * 3600


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _active(spark, sf) -> DataFrame:
    return file_records(spark, sf).where("not deleted").select("doc_id")


def _sessions(gap, source="usage"):
    return f"""numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= {gap} then 0 else 1 end as fresh from {source}))"""


@_register("sessions_gap", f"with {USAGE}, {_sessions(1800)} select event_id, user_id, session::bigint as session from numbered")
def sessions_gap(spark, sf):
    return B.sessions(usage_events(spark, sf)).select("event_id", "user_id", "session")


FILES_IN = """string_agg(doc_id::varchar, ',' order by first_ts, first_id) as files from (select user_id, session, doc_id, min(ts) as first_ts, arg_min(event_id, (ts, event_id)) as first_id from numbered where kind <> 'query' group by all) group by user_id, session"""


@_register("session_context", f"""with {USAGE}, {_sessions(GAP)}, sized as (select user_id, session, min(ts) as first, max(ts) as last, count(*) as events from numbered group by all), f as (select user_id, session, {FILES_IN})
select s.user_id, s.session::bigint as session, first, last, events::bigint as events, coalesce(files, '') as files from sized s left join f using (user_id, session)""")
def session_context(spark, sf):
    return B.session_summary(usage_events(spark, sf), GAP)


@_register("current_session", f"""with {USAGE}, {_sessions(GAP)}, sized as (select user_id, session, max(ts) as last, count(*) as events from numbered group by all)
select user_id, session::bigint as session, last, events::bigint as events from (select *, row_number() over (partition by user_id order by session desc) as n from sized) where n = 1 and {NOW} - last <= {3 * GAP}""")
def current_session(spark, sf):
    numbered = B.sessions(usage_events(spark, sf), GAP).groupBy("user_id", "session").agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("session"))
    return numbered.withColumn("n", F.row_number().over(latest)).where((F.col("n") == 1) & (F.lit(NOW) - F.col("last") <= 3 * GAP)).drop("n")


DECAY = f"pow(0.5::double, greatest({NOW} - ts, 0) / 1209600.0)"
WEIGHT = "case kind when 'file_opened' then 3.0::double when 'recommendation_clicked' then 3.0 when 'file_revealed' then 2.0 when 'result_clicked' then 1.0 end"
ACTIVITY = f"""{USAGE}, {RECORDS}, active as (select doc_id from records where not deleted),
weighted as (select user_id, doc_id, {WEIGHT} * {DECAY} as w from usage where kind <> 'query' union all
  select user_id, unnest(results[1:5]) as doc_id, 0.15::double * {DECAY} as w from usage where kind = 'query'),
raw as (select user_id, doc_id, sum(w) as score from weighted where doc_id in (select doc_id from active) group by all),
act as (select user_id, doc_id, round(score, 6) as score, round(score / max(score) over (partition by user_id), 6) as normalised from raw)"""


@_register("activity_score", f"with {ACTIVITY} select user_id, doc_id, score, normalised from act")
def activity_score(spark, sf):
    return B.activity(usage_events(spark, sf), _active(spark, sf))


@_register("type_shares", f"""with {USAGE}, {RECORDS}, used as (select user_id, ext, sum({WEIGHT} * {DECAY}) as w from usage join records using (doc_id) where kind <> 'query' group by all)
select user_id, ext, round(w / sum(w) over (partition by user_id), 6) as share from used""")
def type_shares(spark, sf):
    return B.type_shares(usage_events(spark, sf), file_records(spark, sf))


SLOTS = "slotted as (select *, (isodow(moment) - 1)::bigint as weekday, (hour(moment) // 4)::bigint as slot from usage where kind <> 'query')"


@_register("slot_histogram", f"with {USAGE}, {SLOTS} select user_id, weekday, slot, count(*)::bigint as n from slotted group by all")
def slot_histogram(spark, sf):
    return B.slot_histogram(usage_events(spark, sf))


@_register("slot_cube", f"with {USAGE}, {SLOTS} select weekday, slot, count(*)::bigint as n from slotted group by cube (weekday, slot)")
def slot_cube(spark, sf):
    return B.slots(usage_events(spark, sf).where("kind <> 'query'")).cube("weekday", "slot").agg(F.count("*").alias("n"))


@_register("usual_slot", f"""with {USAGE}, {SLOTS}, by_ as (select user_id, doc_id, weekday, slot, count(*)::bigint as n from slotted group by all)
select user_id, doc_id, weekday, slot, n from by_ qualify row_number() over (partition by user_id, doc_id order by n desc, weekday, slot) = 1""")
def usual_slot(spark, sf):
    return B.usual_slot(usage_events(spark, sf))


@_register("last_touched", f"with {USAGE} select doc_id, max(ts) as last from usage where kind <> 'query' group by doc_id")
def last_touched(spark, sf):
    return usage_events(spark, sf).where("kind <> 'query'").groupBy("doc_id").agg(F.max("ts").alias("last"))


@_register("top_files", f"with {ACTIVITY} select user_id, doc_id, score, rank::bigint as rank from (select *, row_number() over (partition by user_id order by score desc, doc_id) as rank from act) where rank <= 10")
def top_files(spark, sf):
    line = Window.partitionBy("user_id").orderBy(F.desc("score"), "doc_id")
    return B.activity(usage_events(spark, sf), _active(spark, sf)).withColumn("rank", F.row_number().over(line).cast("long")).where("rank <= 10").select("user_id", "doc_id", "score", "rank")


COOC = f"""numbered_used as (select * from usage where kind <> 'query'), {_sessions(GAP, 'numbered_used')},
used as (select distinct user_id, session, doc_id from numbered where doc_id in (select doc_id from active)),
cooc as (select a.user_id, a.doc_id as a, b.doc_id as b, count(*)::bigint as sessions from used a join used b using (user_id, session) where a.doc_id <> b.doc_id group by all)"""


@_register("cooccurrence", f"with {ACTIVITY}, {COOC} select user_id, a, b, sessions from cooc")
def cooccurrence(spark, sf):
    return B.cooccurrence(usage_events(spark, sf), _active(spark, sf), GAP)


@_register("likely_next", f"""with {ACTIVITY}, {COOC}, last_ as (select distinct n.user_id, n.doc_id as a from numbered n join (select user_id, max(session) as session from numbered group by user_id) m using (user_id, session)),
votes as (select user_id, b as doc_id, sum(sessions)::bigint as votes from cooc join last_ using (user_id, a) group by all)
select user_id, doc_id, votes, rank::bigint as rank from (select v.*, row_number() over (partition by v.user_id order by votes desc, normalised desc nulls last, v.doc_id desc) as rank from votes v left join act using (user_id, doc_id)
  where not exists (select 1 from last_ l where l.user_id = v.user_id and l.a = v.doc_id)) where rank <= 5""")
def likely_next(spark, sf):
    return B.likely_next(usage_events(spark, sf), _active(spark, sf), GAP)


USUAL = f"""with {ACTIVITY}, {SLOTS}, by_ as (select user_id, doc_id, count(*) as n, sum(case when weekday = 2 and slot = 3 then 1 else 0 end) as here from slotted group by all),
usual as (select user_id, doc_id, round(here / n::double * normalised, 6) as value from by_ join act using (user_id, doc_id) where here >= 2 and here / n::double >= 0.4)"""


@_register("usual_now", f"{USUAL} select user_id, doc_id, value, rank::bigint as rank from (select *, row_number() over (partition by user_id order by value desc, doc_id desc) as rank from usual) where rank <= 5")
def usual_now(spark, sf):
    return B.usual_now(usage_events(spark, sf), _active(spark, sf), 2, 3)


@_register("recent_ranked", f"""{USUAL}, touched as (select user_id, doc_id, max(ts) as ts from usage where kind <> 'query' group by all),
ranked as (select user_id, doc_id, value from usual qualify row_number() over (partition by user_id order by value desc, doc_id desc) <= 5),
rec as (select user_id, doc_id, round(normalised * (0.5 + 0.5 * {DECAY}), 6) as value from act join touched using (user_id, doc_id) where (user_id, doc_id) not in (select (user_id, doc_id) from ranked))
select user_id, doc_id, value, rank::bigint as rank from (select *, row_number() over (partition by user_id order by value desc, doc_id desc) as rank from rec) where rank <= 5""")
def recent_ranked(spark, sf):
    events, active = usage_events(spark, sf), _active(spark, sf)
    return B.recent_ranked(events, active, B.usual_now(events, active, 2, 3))


@_register("cold_start_recent", f"""with {USAGE}, {RECORDS}, few as (select user_id from usage group by user_id having count(*) < 20),
newest as (select doc_id, row_number() over (order by modified_time desc, doc_id desc) as rank from records where not deleted and indexed)
select user_id, doc_id, rank::bigint as rank from few, newest where rank <= 5""")
def cold_start_recent(spark, sf):
    return B.cold_start(usage_events(spark, sf), file_records(spark, sf))


@_register("frequently_used", f"with {USAGE}, {RECORDS} select lower(path) as path, count(*)::bigint as opens from usage join records using (doc_id) where kind = 'file_opened' and ts >= {NOW} - 30 * 86400 group by 1 having count(*) >= 3 order by opens desc, path limit 50")
def frequently_used(spark, sf):
    return B.frequently_used(usage_events(spark, sf), file_records(spark, sf))


@_register("time_affinity", f"with {USAGE}, {SLOTS} select user_id, doc_id, round(least(1.0::double, 0.6::double * avg((slot = 3)::int) + 0.4::double * 7 * avg((slot = 3 and weekday = 2)::int)), 6) as affinity from slotted group by all")
def time_affinity(spark, sf):
    return B.time_affinity(usage_events(spark, sf), 2, 3)


CENTRES = """flat as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
means as (select label, i, avg(x) as x from flat group by all), centres as (select label as topic, i, round(x / n, 6) as x from (select *, sqrt(sum(x * x) over (partition by label)) as n from means) where n > 0)"""


@_register("topic_affinity", f"""with {CENTRES}, dots as (select vec_id, topic, round(sum(f.x * c.x) / sqrt(sum(f.x * f.x)), 6) as cosine from flat f join centres c using (i) group by all)
select vec_id, topic, greatest(cosine, 0) as affinity from dots qualify row_number() over (partition by vec_id order by cosine desc, topic) = 1""")
def topic_affinity(spark, sf):
    v = read(spark, sf, "embeddings")
    return B.topic_affinity(v, R.centroids(v, "label").withColumnRenamed("label", "topic"))


@_register("topic_kmeans")
def topic_kmeans(spark, sf):
    return B.topics(read(spark, sf, "embeddings").select("vec_id", "embedding")).groupBy("topic").agg(F.count("*").alias("members"))


@_register("topic_labels", f"""with {CHUNKS}, toks as (select doc_id % 4 as topic, unnest({tokens_sql('content')}) as term, (doc_id % 10) / 10.0::double as score from chunks),
by_ as (select topic, term, sum(0.25::double + score) as w from toks group by all), df as (select term, count(distinct topic) as df from toks group by term),
val as (select topic, term, round(w * ln(1 + (max(df) over ()) / df::double), 6) as value from by_ join df using (term))
select topic, term, value, rank::bigint as rank from (select *, row_number() over (partition by topic order by value desc, term) as rank from val) where rank <= 3""")
def topic_labels(spark, sf):
    toks = chunks(spark, sf).select((F.col("doc_id") % 4).alias("topic"), F.explode(T.tokens("content")).alias("term"), ((F.col("doc_id") % 10) / 10).alias("score"))
    return B.topic_labels(toks)


@_register("personal_boost", f"""with {ACTIVITY}, {SLOTS}, {CENTRES}, ta as (select user_id, doc_id, round(least(1.0::double, 0.6::double * avg((slot = 3)::int) + 0.4::double * 7 * avg((slot = 3 and weekday = 2)::int)), 6) as t, max(ts) as ts from slotted group by all),
used as (select user_id, ext, sum({WEIGHT} * {DECAY}) as w from usage join records using (doc_id) where kind <> 'query' group by all),
shares as (select user_id, ext, round(w / sum(w) over (partition by user_id), 6) as share from used),
dots as (select vec_id, topic, round(sum(f.x * c.x) / sqrt(sum(f.x * f.x)), 6) as cosine from flat f join centres c using (i) group by all),
topics as (select vec_id as doc_id, greatest(max(cosine), 0) as affinity from dots group by vec_id)
select user_id, doc_id, round(0.35::double * normalised + 0.15::double * coalesce(case when ts is not null then round({DECAY}, 6) end, 0) + 0.15::double * coalesce(share, 0) + 0.2::double * coalesce(affinity, 0) + 0.15::double * coalesce(t, 0), 8) as boost
from act left join ta using (user_id, doc_id) left join records using (doc_id) left join shares using (user_id, ext) left join topics using (doc_id)""")
def personal_boost(spark, sf):
    from heliograph.operators.ranking import personal_boost as boost

    events, records, v = usage_events(spark, sf), file_records(spark, sf), read(spark, sf, "embeddings")
    last = events.where("kind <> 'query'").groupBy("user_id", "doc_id").agg(F.max("ts").alias("ts"))
    both = ["user_id", "doc_id"]
    signals = B.activity(events, _active(spark, sf)).withColumnRenamed("normalised", "frequency").join(B.time_affinity(events, 2, 3).withColumnRenamed("affinity", "time"), both, "left").join(last, both, "left")
    types = B.type_shares(events, records).withColumnRenamed("share", "type")
    topics = B.topic_affinity(v, R.centroids(v, "label").withColumnRenamed("label", "topic")).select(F.col("vec_id").alias("doc_id"), F.col("affinity").alias("topic"))
    signals = signals.join(records.select("doc_id", "ext"), "doc_id", "left").join(types, ["user_id", "ext"], "left").join(topics, "doc_id", "left")
    ready = signals.select("user_id", "doc_id", "frequency", F.round(B.decay(F.col("ts"), NOW), 6).alias("recency"), "type", "topic", "time")
    return boost(ready).select("user_id", "doc_id", "boost")


def _profile(spark, sf):
    """All users' profiles after three refreshes, each with the events since the one before."""
    events, day = usage_events(spark, sf), 86400
    profile = Profile(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")
    cuts = [NOW - 20 * day, NOW - 5 * day]
    for low, high, now in ((None, cuts[0], cuts[0]), (cuts[0], cuts[1], cuts[1]), (cuts[1], None, NOW)):
        since = events if low is None else events.where(F.col("ts") > low)
        profile.refresh(since if high is None else since.where(F.col("ts") <= high), now)
    return profile


@_register("profile_refresh", f"with {ACTIVITY} select user_id, doc_id, score, normalised from act")
def profile_refresh(spark, sf):
    return _profile(spark, sf).activity(_active(spark, sf))


@_register("profile_types", SQL["type_shares"])
def profile_types(spark, sf):
    return _profile(spark, sf).type_shares(file_records(spark, sf))


@_register("profile_slots", SQL["slot_histogram"])
def profile_slots(spark, sf):
    return _profile(spark, sf).slot_histogram()


@_register("tumbling_slots", f"with {USAGE} select time_bucket(interval 4 hours, moment, timestamp '2024-01-01 00:00:00') as slot_start, kind, count(*)::bigint as n from usage group by all")
def tumbling_slots(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "4 hours")
    return usage_events(spark, sf).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("slot_start"), "kind", "n")


# -- lifecycle ----------------------------------------------------------------------------------------------------


def _old_new(spark, sf):
    r = file_records(spark, sf, hashed=True)
    old = r.where("doc_id % 11 <> 0").select("path", "hash")
    path = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("/moved"), F.col("path"))).otherwise(F.col("path"))
    changed = F.when(F.col("doc_id") % 19 == 0, F.sha2(F.concat(F.col("hash"), F.lit("x")), 256)).otherwise(F.col("hash"))
    return old, r.where("doc_id % 13 <> 0").select(path.alias("path"), changed.alias("hash"))


SNAP = f"""{RECORDS}, old_ as (select path, hash from records where doc_id % 11 <> 0),
new_ as (select case when doc_id % 17 = 0 then '/moved' || path else path end as path, case when doc_id % 19 = 0 then sha256(hash || 'x') else hash end as hash from records where doc_id % 13 <> 0),
fresh as (select path, hash, row_number() over (partition by hash order by path) as n from new_ where path not in (select path from old_)),
gone as (select path as old_path, hash, row_number() over (partition by hash order by path) as n from old_ where path not in (select path from new_)),
moved as (select old_path, path from fresh join gone using (hash, n))"""


@_register("snapshot_diff", f"""with {SNAP} select n.path, n.hash, case when o.hash = n.hash then 'unchanged' else 'modified' end as status from new_ n join old_ o using (path)
union all select path, hash, case when path in (select path from moved) then 'renamed' else 'new' end from fresh union all select old_path, hash, 'deleted' from gone where old_path not in (select old_path from moved)""")
def snapshot_diff(spark, sf):
    return Y.snapshot_diff(*_old_new(spark, sf))


@_register("scan_statistics", f"""with {SNAP}, d as (select case when o.hash = n.hash then 'unchanged' else 'modified' end as status from new_ n join old_ o using (path)
union all select case when path in (select path from moved) then 'renamed' else 'new' end from fresh union all select 'deleted' from gone where old_path not in (select old_path from moved)) select status, count(*)::bigint as n from d group by status""")
def scan_statistics(spark, sf):
    return Y.snapshot_diff(*_old_new(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@_register("rename_detect", f"with {SNAP} select old_path, path from moved")
def rename_detect(spark, sf):
    return Y.renames(*_old_new(spark, sf))


@_register("record_upsert", f"""with {RECORDS}, fresh as (select file_id || 'n' as file_id, path, size + 1 as size from records where doc_id % 7 = 0 union all select file_id, path, size + 2 from records where doc_id % 7 = 1)
select file_id, case when path in (select path from fresh) then path || chr(0) || file_id else path end as path, size from records where file_id not in (select file_id from fresh) union all select * from fresh""")
def record_upsert(spark, sf):
    r = file_records(spark, sf).select("doc_id", "file_id", "path", "size")
    new = r.where("doc_id % 7 = 0").select(F.concat("file_id", F.lit("n")).alias("file_id"), "path", (F.col("size") + 1).alias("size")).union(r.where("doc_id % 7 = 1").select("file_id", "path", F.col("size") + 2))
    return Y.upsert(r.drop("doc_id"), new)


@_register("duplicate_reuse", f"""with {RECORDS}, live as (select * from records where not deleted and indexed)
select r.doc_id, min(l.doc_id)::bigint as reuse_from from records r join live l on r.hash = l.hash and r.doc_id <> l.doc_id group by r.doc_id""")
def duplicate_reuse(spark, sf):
    return Y.duplicate_reuse(file_records(spark, sf, hashed=True))


@_register("tombstone_purge", f"with {CHUNKS}, {RECORDS} select chunk_id, c.doc_id from chunks c where doc_id not in (select doc_id from records where deleted)")
def tombstone_purge(spark, sf):
    return Y.purge(chunks(spark, sf), file_records(spark, sf), "doc_id").select("chunk_id", "doc_id")


@_register("vanished_purge", f"with {SNAP} select doc_id, path from records where not deleted and path not in (select path from new_) and path not like '/src3/%'")
def vanished_purge(spark, sf):
    return Y.vanished(file_records(spark, sf), _old_new(spark, sf)[1], ["/src3"]).select("doc_id", "path")


def _log(spark, sf):
    return file_records(spark, sf).where("deleted").select("doc_id", "path", (F.lit(NOW) - (F.col("doc_id") % 40) * 86400).alias("deleted_at"))


LOG = f"{RECORDS}, log as (select doc_id, path, {NOW} - (doc_id % 40) * 86400 as deleted_at from records where deleted)"


@_register("retention_trim", f"with {LOG} select doc_id, deleted_at::double as deleted_at from log where deleted_at >= {NOW} - 30 * 86400")
def retention_trim(spark, sf):
    return Y.retention(_log(spark, sf)).select("doc_id", "deleted_at")


@_register("deleted_recently", f"with {LOG}, inside as (select * from log where deleted_at between {NOW} - 7 * 86400 and {NOW}) select doc_id, path, deleted_at::double as deleted_at, (select count(*) from inside)::bigint as total from inside order by deleted_at desc, doc_id limit 10")
def deleted_recently(spark, sf):
    return C.deleted_recently(_log(spark, sf))


ROOTS = ("/src1", "/src1/en", "/src2")


def _roots(spark):
    return spark.sql("select * from values ('/src1'), ('/src1/en'), ('/src2') as t(root)")


@_register("deepest_root", f"with {RECORDS} select doc_id, root from records, unnest({list(ROOTS)}) as t(root) where starts_with(path, root || '/') qualify row_number() over (partition by doc_id order by length(root) desc) = 1")
def deepest_root(spark, sf):
    return Y.deepest_root(file_records(spark, sf), _roots(spark))


@_register("folder_stats", f"""with {RECORDS}, d as (select doc_id, root from records, unnest({list(ROOTS)}) as t(root) where starts_with(path, root || '/') qualify row_number() over (partition by doc_id order by length(root) desc) = 1)
select root, sum((ext in ('md', 'txt', 'pdf', 'docx', 'csv', 'html', 'py'))::int)::bigint as documents, sum((ext = 'jpg')::int)::bigint as photos, sum((ext = 'mp4' and not coalesce(audio_only, false))::int)::bigint as videos,
  sum((ext = 'mp3' or (ext = 'mp4' and coalesce(audio_only, false)))::int)::bigint as audio from d join records using (doc_id) group by root""")
def folder_stats(spark, sf):
    from heliograph.operators.filters import kind_of

    r = file_records(spark, sf)
    kinds = Y.deepest_root(r, _roots(spark)).join(r, "doc_id").withColumn("kind", kind_of(F.col("ext"), F.col("audio_only")))
    n = lambda *k: F.sum(F.when(F.col("kind").isin(*k), 1).otherwise(0))
    return kinds.groupBy("root").agg(n("document", "code").alias("documents"), n("image").alias("photos"), n("video").alias("videos"), n("audio").alias("audio"))


@_register("folder_listing", f"with {RECORDS} select path, rank::bigint as rank from (select path, row_number() over (order by lower(regexp_extract(path, '[^/]*$', 0)), path) as rank from records where not deleted) where rank between 51 and 100")
def folder_listing(spark, sf):
    """One page of a listing by name: an offset and a limit on one global order."""
    page = file_records(spark, sf).where("not deleted").select("path", F.lower(T.filename("path")).alias("name")).orderBy("name", "path").offset(50).limit(50)
    return page.select("path", (F.row_number().over(Window.orderBy("name", "path")) + 50).cast("long").alias("rank"))


# -- collection ---------------------------------------------------------------------------------------------------


@_register("collection_counts", f"with {RECORDS} select ext, count(*)::bigint as n from records where not deleted group by ext order by n desc, ext limit 4")
def collection_counts(spark, sf):
    return C.summary(file_records(spark, sf))


@_register("collection_by_kind", f"""with {RECORDS}, live as (select ext, doc_id, regexp_extract(path, '[^/]*$', 0) as name, row_number() over (partition by ext order by doc_id) as n, count(*) over (partition by ext) as total from records where not deleted and indexed)
select ext, total::bigint as n, string_agg(name, ', ' order by doc_id) as examples from live where n <= 3 group by ext, total""")
def collection_by_kind(spark, sf):
    return C.by_kind(file_records(spark, sf))


@_register("newest_files", f"with {RECORDS} select doc_id, modified_time from records where not deleted order by modified_time desc, doc_id limit 10")
def newest_files(spark, sf):
    return C.newest(file_records(spark, sf)).select("doc_id", "modified_time")


STATES = f"""{RECORDS}, states as (select regexp_extract(path, '[^/]*$', 0) as name, case when deleted then 4 when not indexed then 2 when doc_id % 31 = 0 then 3 else 1 end as tier, case when deleted then 'deleted' when not indexed then 'failed' when doc_id % 31 = 0 then 'skipped' else 'indexed' end as state from records),
asked as (select distinct case when doc_id % 3 = 0 then name when doc_id % 3 = 1 then replace(name, 'doc_', 'dok_') else 'zz' || name end as name from (select doc_id, regexp_extract(path, '[^/]*$', 0) as name from records where doc_id % 50 = 0))"""


@_register("why_missing", f"""with {STATES}, exact as (select name, arg_min(state, (tier, state)) as state from asked join states using (name) group by name),
near as (select a.name, count(distinct s.name) as n from asked a, states s where a.name not in (select name from exact) and abs(length(a.name) - length(s.name)) <= 1 and levenshtein(a.name, s.name) <= 1 group by a.name)
select a.name, coalesce(e.state, case when n = 1 then 'similar' else 'unknown' end) as state from asked a left join exact e using (name) left join near using (name)""")
def why_missing(spark, sf):
    r = file_records(spark, sf).withColumn("name", T.filename("path"))
    tier = F.when(F.col("deleted"), 4).when(~F.col("indexed"), 2).when(F.col("doc_id") % 31 == 0, 3).otherwise(1)
    state = F.element_at(F.array(*map(F.lit, ("indexed", "failed", "skipped", "deleted"))), tier)
    name = F.when(F.col("doc_id") % 3 == 0, F.col("name")).when(F.col("doc_id") % 3 == 1, F.replace("name", F.lit("doc_"), F.lit("dok_"))).otherwise(F.concat(F.lit("zz"), "name"))
    return C.why_missing(r.where("doc_id % 50 = 0").select(name.alias("name")).distinct(), r.select("name", tier.alias("tier"), state.alias("state")))


PAIRS = f"{CHUNKS}, pairs as (select chunk_id, array_to_string(regexp_split_to_array(content, ' ')[1:8], ' ') || ' 1,' || lpad((doc_id % 1000)::varchar, 3, '0') as answer, content as source from chunks)"


def _pairs(spark, sf):
    number = F.concat(F.lit(" 1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    return chunks(spark, sf).select("chunk_id", F.concat(F.array_join(F.slice(F.split("content", " "), 1, 8), " "), number).alias("answer"), F.col("content").alias("source"))


@_register("grounding_score", f"""with {PAIRS}, w as (select chunk_id, list_distinct(list_filter({tokens_sql('answer')}, lambda x: not list_contains({STOP_WORDS}, x) and length(x) > 1)) as aw, {tokens_sql('source')} as st from pairs),
v as (select chunk_id, list_sum(list_transform(aw, lambda x: case when regexp_matches(x, '[0-9]') then 2 else 1 end)) as total, coalesce(list_sum(list_transform(list_filter(aw, lambda x: list_contains(st, x)), lambda x: case when regexp_matches(x, '[0-9]') then 2 else 1 end)), 0) as weight from w)
select chunk_id, weight::bigint as weight, case when total > 0 then round(weight / total::double, 6) else 0.0 end as share, weight >= 3 or case when total > 0 then round(weight / total::double, 6) else 0.0 end >= 0.5 as supports from v""")
def grounding_score(spark, sf):
    return C.grounding(_pairs(spark, sf)).select("chunk_id", "weight", "share", "supports")


@_register("figure_check", rf"""with {PAIRS}, n as (select chunk_id, regexp_extract_all(regexp_replace(answer, '(\d),(\d)', '\1\2', 'g'), '\d+(?:\.\d+)?') as a, regexp_extract_all(regexp_replace(source, '(\d),(\d)', '\1\2', 'g'), '\d+(?:\.\d+)?') as s from pairs)
select chunk_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(s, x)))), ',') as missing from n""")
def figure_check(spark, sf):
    return C.figures_missing(_pairs(spark, sf)).select("chunk_id", "missing")


@_register("quick_answer")
def quick_answer(spark, sf):
    from heliograph.fixtures import text_queries

    asked = text_queries(spark, sf)
    hits = R.bm25_relaxed(asked, index(spark, sf), 3).join(index(spark, sf).chunks().select("chunk_id", "content"), "chunk_id")
    return C.quick_answer(asked.select(F.col("query_id").alias("question_id"), F.col("query").alias("question")), hits.select(F.col("query_id").alias("question_id"), "chunk_id", "content"))


MEDIA = """scores as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as distance from embeddings v, (select * from embeddings where vec_id % 50 = 0) q),
near as (select * from scores qualify row_number() over (partition by query_id order by distance, vec_id) <= 100)"""


def _scores(spark, sf):
    """Each query's 100 nearest."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return R.knn(asked, v, 100)


@_register("visual_tiers", f"""with {MEDIA}, ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as n from scores),
b as (select query_id, count(*) as size, min(distance) as best, max(case when n = 100 then distance end) as ref from ranked group by query_id),
bound as (select *, case when size > 130 then greatest(1.40::double, 1.51::double - 0.05::double * (sqrt(2 * ln(size)) - sqrt(2 * ln(130.0::double)))) else 1.51 end as bound from b),
lim as (select *, least(bound, best + 0.04::double, ref - 0.07::double) as strong, least(1.55::double, bound + 0.03::double, best + 0.08::double, ref - 0.04::double) as possible from bound)
select query_id, round(strong, 6) as strong, round(greatest(strong, possible), 6) as possible from lim""")
def visual_tiers(spark, sf):
    return C.media_limits(_scores(spark, sf), read(spark, sf, "embeddings").where("embedding is not null").count())


@_register("visual_best_per_file", f"with {MEDIA} select query_id, (vec_id // 4)::bigint as file_id, vec_id, distance from scores qualify row_number() over (partition by query_id, vec_id // 4 order by distance, vec_id) = 1")
def visual_best_per_file(spark, sf):
    """Every file by its frame that is nearest to the query."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 4).alias("file_id"))
    return R.nearest_of_groups(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), v, "file_id")
