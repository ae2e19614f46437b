"""Registered queries on stored records, vectors and events, listings, evaluation and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.config import NOW
from heliograph.fixtures import CHUNKS, RECORDS, USAGE, chunks, file_records, index, read, text_queries, usage_events
from heliograph.functions import text as T
from heliograph.operators import answers as A
from heliograph.operators import browsing as W
from heliograph.operators import evaluation as E
from heliograph.operators import filters as L
from heliograph.operators import retrieval as R
from heliograph.operators import store as S
from heliograph.operators.filters import kind_of

Q: dict = {}
SQL: dict[str, str] = {}


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


NAME = "regexp_extract(path, '[^/]*$', 0)"


def _records(spark, sf):
    return file_records(spark, sf).select("file_id", "doc_id", "path", "size", "modified_time", "deleted", "indexed")


# -- records and vectors ---------------------------------------------------------------------------------------------


@_register("path_lookup", f"""with {RECORDS}, asked as (select distinct case when doc_id % 3 = 0 then path when doc_id % 3 = 1 then upper(path) else path || 'x' end as asked from records where doc_id % 7 = 0)
select asked, file_id, path from asked a join records r on lower(r.path) = lower(a.asked) qualify row_number() over (partition by asked order by path = asked desc, deleted, file_id) = 1""")
def path_lookup(spark, sf):
    r = _records(spark, sf)
    asked = r.where("doc_id % 7 = 0").select(F.when(F.col("doc_id") % 3 == 0, F.col("path")).when(F.col("doc_id") % 3 == 1, F.upper("path")).otherwise(F.concat("path", F.lit("x"))).alias("path"))
    return S.lookup(r, asked).select("asked", "file_id", "path")


@_register("rename_apply", f"""with {RECORDS}, moves as (select path as old_path, case when doc_id % 20 = 0 then replace(path, '/doc_', '/moved_') else regexp_replace(path, 'doc_[0-9]+', 'doc_' || (doc_id + 1)) end as new_path from records where doc_id % 10 = 0 and doc_id % 30 <> 20)
select file_id, coalesce(m.new_path, case when r.path in (select new_path from moves) then r.path || chr(0) || file_id else r.path end) as path from records r left join moves m on m.old_path = r.path""")
def rename_apply(spark, sf):
    r = _records(spark, sf).select("file_id", "path", "doc_id")
    new = F.when(F.col("doc_id") % 20 == 0, F.replace("path", F.lit("/doc_"), F.lit("/moved_"))).otherwise(F.regexp_replace("path", F.lit("doc_[0-9]+"), F.concat(F.lit("doc_"), (F.col("doc_id") + 1).cast("string"))))
    moves = r.where("doc_id % 10 = 0 and doc_id % 30 <> 20").select(F.col("path").alias("old_path"), new.alias("path"))
    return S.rename(r, moves).select("file_id", "path")


@_register("tombstone_log", f"""with {RECORDS}, gone as (select file_id, path, {NOW}::double as deleted_at from records where not deleted and doc_id % 5 = 0),
old_log as (select file_id, path, {NOW} - doc_id * 40000.0::double as deleted_at from records where deleted)
select file_id, path, deleted_at from (select * from gone union all select * from old_log) where deleted_at >= {NOW} - 30 * 86400""")
def tombstone_log(spark, sf):
    r = _records(spark, sf)
    log = r.where("deleted").select("file_id", "path", (F.lit(NOW) - F.col("doc_id") * 40000.0).alias("deleted_at"))
    return S.forget(r, log, r.where("doc_id % 5 = 0"))[1]


@_register("chunk_reuse", f"""with {CHUNKS}, reuse as (select doc_id, doc_id + 1 as donor from (select distinct doc_id from chunks where doc_id % 11 = 0))
select u.doc_id || '#' || c.chunk_index as chunk_id, u.doc_id, c.content from chunks c join reuse u on c.doc_id = u.donor""")
def chunk_reuse(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "doc_id", "content")
    reuse = c.where("doc_id % 11 = 0").select("doc_id").distinct().withColumn("reuse_from", F.col("doc_id") + 1)
    return S.copied_chunks(c, reuse)


@_register("vector_upsert", "select vec_id, label + 100 as label from embeddings where vec_id % 3 = 0 union all select vec_id, label from embeddings where vec_id % 3 <> 0")
def vector_upsert(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label")
    return S.put_vectors(v, v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id")


@_register("model_change", f"""with {RECORDS}, lost as (select distinct vec_id // 4 as doc_id from embeddings where label % 2 = 1)
select doc_id, indexed and doc_id not in (select doc_id from lost) as indexed from records""")
def model_change(spark, sf):
    v = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("doc_id"), F.when(F.col("label") % 2 == 1, "old").otherwise("new").alias("model"))
    return S.for_model(v, _records(spark, sf), "new")[1].select("doc_id", "indexed")


@_register("library_size", "select case when label % 3 = 0 then 'video' else 'photo' end as kind, count(*)::bigint as n from embeddings group by 1")
def library_size(spark, sf):
    return S.library_size(read(spark, sf, "embeddings").select(F.when(F.col("label") % 3 == 0, "video").otherwise("photo").alias("kind")))


@_register("containment", f"with {RECORDS} select doc_id from records where lower(path) like '/src1/%' or lower(path) like '/src2/en/%' or path = (select path from records where doc_id = 7)")
def containment(spark, sf):
    r = _records(spark, sf)
    roots = spark.createDataFrame([("/SRC1/",), ("/src2/en",), ("/nowhere",)], "root string").union(r.where("doc_id = 7").select("path"))
    return L.contained(r, roots).select("doc_id")


@_register("span_lookup", f"""with {CHUNKS}, blocks as (select doc_id, chunk_index * 300 + 50 as start, chunk_index * 300 + 250 as stop, chunk_index as page from chunks where chunk_index % 3 <> 1),
asked as (select doc_id, chunk_id, chunk_index * 170 as at from chunks)
select a.doc_id, a.chunk_id, b.start::bigint as start, b.page::bigint as page from asked a join blocks b using (doc_id)
qualify row_number() over (partition by a.chunk_id order by b.start <= a.at desc, case when b.start <= a.at then -b.start else b.start end) = 1""")
def span_lookup(spark, sf):
    c = chunks(spark, sf)
    blocks = c.where("chunk_index % 3 <> 1").select("doc_id", (F.col("chunk_index") * 300 + 50).alias("start"), (F.col("chunk_index") * 300 + 250).alias("end"), F.col("chunk_index").alias("page"))
    return S.spans_at(c.select("doc_id", "chunk_id", (F.col("chunk_index") * 170).alias("start_offset")), blocks)


@_register("payload_fill", f"with {CHUNKS} select chunk_id, case when chunk_index % 2 = 0 then page_number else 900 end as page_number from chunks")
def payload_fill(spark, sf):
    hits = index(spark, sf).chunks().select("chunk_id", F.when(F.col("chunk_index") % 2 == 1, F.lit(900).cast("long")).alias("page_number"))
    return R.filled(hits, index(spark, sf).chunks().select("chunk_id", "page_number"))


# -- events ----------------------------------------------------------------------------------------------------------


def _log(spark, sf):
    """All users' logs with a third of each imported."""
    e = usage_events(spark, sf).select("event_id", "user_id", "ts", "kind", F.col("doc_id").cast("string").alias("file_id"), F.lit(None).cast("string").alias("path"), F.when(F.col("kind") == "query", F.concat(F.lit("Find "), F.col("doc_id").cast("string"))).alias("query"), F.when(F.col("event_id") % 3 == 0, "old").alias("source"))
    numbered = S.with_sessions(e, by=("source",))
    return numbered.withColumn("session", F.col("session") + F.when(F.col("source").isNull(), 0).otherwise(1_000_000))


LOG = f"""{USAGE}, raw as (select event_id, user_id, ts, kind, doc_id::varchar as file_id, case when kind = 'query' then 'Find ' || doc_id end as query, case when event_id % 3 = 0 then 'old' end as source from usage),
seen as (select *, max(ts) over (partition by user_id, source order by event_id rows between unbounded preceding and 1 preceding) as before from raw),
log as (select * exclude (before), (sum(case when before is null or ts - before > 1800 then 1 else 0 end) over (partition by user_id, source order by event_id) + case when source is null then 0 else 1000000 end)::bigint as session from seen)"""


@_register("event_append", f"""with {LOG}, own as (select * from log where source is null), cut as (select event_id, user_id, ts, kind, source from own where event_id % 2 = 0),
old_ as (select event_id, user_id, ts, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from cut),
old_s as (select event_id, user_id, ts, (sum(case when before is null or ts - before > 1800 then 1 else 0 end) over (partition by user_id order by event_id))::bigint as session from old_),
top as (select user_id, max(ts) as ts, max(session) as session from old_s group by user_id),
new_ as (select event_id + 10000000 as event_id, user_id, ts + 40 * 86400 as ts from own where event_id % 2 = 1),
new_b as (select n.*, greatest(max(n.ts) over (partition by n.user_id order by event_id rows between unbounded preceding and 1 preceding), t.ts) as before, coalesce(t.session, 0) as base from new_ n left join top t using (user_id)),
new_s as (select event_id, user_id, ts, (sum(case when before is null or ts - before > 1800 then 1 else 0 end) over (partition by user_id order by event_id) + base)::bigint as session from new_b)
select event_id, user_id, session from old_s union all select event_id, user_id, session from new_s""")
def event_append(spark, sf):
    own = _log(spark, sf).where("source is null")
    old = S.with_sessions(own.where("event_id % 2 = 0").drop("session"))
    new = own.where("event_id % 2 = 1").withColumn("event_id", F.col("event_id") + 10_000_000).withColumn("ts", F.col("ts") + 40 * 86400)
    return S.append_events(old.select(*own.columns), new).select("event_id", "user_id", "session")


@_register("event_replace_source", f"""with {LOG}, top as (select user_id, max(session) as top from log group by user_id), new_ as (select event_id + 5 as event_id, user_id, ts from log where source = 'old' and event_id % 2 = 0),
b as (select *, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from new_)
select event_id, user_id, session, source from log where source is null
union all select event_id, user_id, (sum(case when before is null or ts - before > 1800 then 1 else 0 end) over (partition by user_id order by event_id) + top)::bigint as session, 'old' as source from b join top using (user_id)""")
def event_replace_source(spark, sf):
    log = _log(spark, sf)
    new = log.where("source = 'old' and event_id % 2 = 0").withColumn("event_id", F.col("event_id") + 5)
    return S.replace_source(log, "old", new).select("event_id", "user_id", "session", "source")


@_register("event_clear_source", f"with {LOG} select event_id, session from log where source is distinct from 'old'")
def event_clear_source(spark, sf):
    return S.clear_source(_log(spark, sf), "old").select("event_id", "session")


@_register("event_recent", f"with {LOG} select user_id, event_id, ts from log where kind in ('file_opened', 'query') and ts >= {NOW} - 25 * 86400 qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 40")
def event_recent(spark, sf):
    return S.recent(_log(spark, sf), 40, ("file_opened", "query"), NOW - 25 * 86400).select("user_id", "event_id", "ts")


@_register("training_queries", f"""with {LOG}, newest as (select * from log where kind = 'query' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20)
select user_id, query, ts from newest where source is null and event_id % 4 <> 0 qualify row_number() over (partition by user_id, lower(query) order by ts desc, event_id desc) = 1""")
def training_queries(spark, sf):
    return E.training_queries(_log(spark, sf).withColumn("mode", F.when(F.col("event_id") % 4 == 0, "visual")), 20)


OPENS = f"{USAGE}, {RECORDS}, opens as (select path, ts from usage join records using (doc_id) where kind = 'file_opened')"


@_register("newest_open", f"with {OPENS}, both_ as (select path, ts from opens union all select upper(path), ts + 7 from opens where floor(ts)::bigint % 2 = 0) select arg_max(path, (ts, path)) as path, max(ts) as ts from both_ group by lower(path)")
def newest_open(spark, sf):
    opens = usage_events(spark, sf).where("kind = 'file_opened'").join(_records(spark, sf).select("doc_id", "path"), "doc_id").select("path", "ts")
    return S.newest_open(opens, opens.where(F.col("ts").cast("long") % 2 == 0).select(F.upper("path").alias("path"), (F.col("ts") + 7).alias("ts")))


@_register("recent_import", f"""with {OPENS}, items as (select path, min(ts) as first, max(ts) as last from opens group by path),
every as (select path, first as ts from items union all select path, last from items where last - first > 60)
select distinct path, ts from every e where not exists (select 1 from opens o where lower(o.path) = lower(e.path) and round(o.ts, 3) = round(e.ts, 3) and floor(o.ts)::bigint % 3 = 0)""")
def recent_import(spark, sf):
    opens = usage_events(spark, sf).where("kind = 'file_opened'").join(_records(spark, sf).select("doc_id", "path"), "doc_id").select("path", "ts")
    items = opens.groupBy("path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return S.imported(opens.where(F.col("ts").cast("long") % 3 == 0), items)


HABITS = [(0, [0, 1, 2, 3, 4, 5, 6], 360, "gym"), (1, [0], 600, "savings"), (2, [0, 1, 2, 3, 4], 850, None), (3, [5, 6], 1320, "trip")]


@_register("sample_history", f"""with habits as (select * from (values (0, [0, 1, 2, 3, 4, 5, 6], 360, 'gym'), (1, [0], 600, 'savings'), (2, [0, 1, 2, 3, 4], 850, null), (3, [5, 6], 1320, 'trip')) as t(habit, weekdays, minute, query)),
days as (select *, (1706659200 - ago * 86400) as day from habits, (select unnest(range(1, 29)) as ago)),
held as (select * from days where list_contains(weekdays, (isodow(to_timestamp(day) at time zone 'UTC') - 1)::int))
select (day + minute * 60 + p * 120)::double as ts, 'file_opened' as kind, habit * 10 + p as file_id, null as query from held, (select unnest([0, 1]) as p)
union all select (day + minute * 60 - 60)::double, 'query', null, query from held where ago % 3 = 0 and query is not null""")
def sample_history(spark, sf):
    habits = spark.createDataFrame(HABITS, "habit int, weekdays array<int>, minute int, query string")
    files = spark.createDataFrame([(h, p, h * 10 + p) for h in range(4) for p in range(2)], "habit int, place int, file_id int")
    return S.sample_history(files, habits, 1706659200.0)


# -- failures --------------------------------------------------------------------------------------------------------


@_register("retry_candidates", f"""with {RECORDS}, hopeless as (select hash from records where doc_id % 9 = 0 and doc_id % 2 = 0 union select hash from records where doc_id % 13 = 0)
select path from records where hash not in (select hash from hopeless)""")
def retry_candidates(spark, sf):
    r = file_records(spark, sf, hashed=True)
    error = F.when(F.col("doc_id") % 2 == 0, "ValueError: bad").otherwise("PermissionError: locked")
    failures = r.where("doc_id % 9 = 0").select("hash", S.retryable(error).alias("retryable"))
    markers = r.where("doc_id % 13 = 0").select("hash")
    return S.to_index(r.select("path", "hash"), failures, markers.union(markers)).select("path")


@_register("settled_extractions", f"""with {RECORDS}, tries as (select path, unnest(range(1, 5)) as attempt, doc_id from records), good as (select * from tries where (doc_id + attempt) % 4 = 0 and attempt <= 3)
select path, attempt::int as attempt from good qualify row_number() over (partition by path order by attempt) = 1""")
def settled_extractions(spark, sf):
    tries = _records(spark, sf).select("path", "doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    after = F.when((F.col("doc_id") + F.col("attempt")) % 4 == 0, "a").otherwise("b")
    return S.settled(tries.withColumns({"hash_before": F.lit("a"), "hash_after": after})).select("path", "attempt")


@_register("failure_ring", f"with {RECORDS} select doc_id from records where not indexed order by modified_time desc limit 20")
def failure_ring(spark, sf):
    return S.ring(_records(spark, sf).where("not indexed"), 20, "modified_time").select("doc_id")


# -- listings --------------------------------------------------------------------------------------------------------

ENTRIES = f"""{RECORDS}, entries as (
  select {NAME} as name, false as is_dir, case when ext in ('jpg') then 'image' when ext = 'mp3' or coalesce(audio_only, false) then 'audio' when ext = 'mp4' then 'video' when ext = 'py' then 'code' else 'document' end as kind, modified_time as modified, indexed, doc_id from records where not deleted
  union all select distinct lang || source, true, 'folder', 0.0::double, source < 'src3', -1 from documents where lang is not null and source is not null)"""


def _entries(spark, sf):
    r = file_records(spark, sf).where("not deleted")
    files = r.select(T.filename("path").alias("name"), F.lit(False).alias("is_dir"), kind_of(F.col("ext"), F.col("audio_only")).alias("kind"), F.col("modified_time").alias("modified"), "indexed", "doc_id")
    folders = read(spark, sf, "documents").where("lang is not null and source is not null").select(F.concat("lang", "source").alias("name"), F.lit(True).alias("is_dir"), F.lit("folder").alias("kind"), F.lit(0.0).alias("modified"), (F.col("source") < "src3").alias("indexed"), F.lit(-1).cast("long").alias("doc_id")).distinct()
    return files.unionByName(folders)


@_register("natural_listing", f"""with {ENTRIES} select name, rank::bigint as rank from (select *, row_number() over (order by is_dir desc, regexp_extract(name, '^[^0-9]*', 0), try_cast(regexp_extract(name, '[0-9]+', 0) as bigint), name) as rank from entries) where rank between 31 and 90""")
def natural_listing(spark, sf):
    """Folders first, numbers by their value."""
    page = W.listed(_entries(spark, sf), 60, 30)
    return page.select("name", (F.row_number().over(Window.orderBy(F.desc("is_dir"), W.natural_key("name"), "name")) + 30).cast("long").alias("rank"))


@_register("listing_counts", f"with {ENTRIES} select count(*)::bigint as total, sum(is_dir::int)::bigint as folders, sum((not is_dir)::int)::bigint as files from entries")
def listing_counts(spark, sf):
    return W.counts(_entries(spark, sf))


@_register("page_filters", f"""with {ENTRIES} select name, 'a' as page from entries where is_dir or (kind = 'document' and {NOW} - modified < 7 * 86400)
union all select name, 'b' from entries where (is_dir or kind in ('other', 'archive', 'code')) and indexed and contains(lower(name), '1')
union all select name, 'c' from entries where is_dir or {NOW} - modified >= 30 * 86400""")
def page_filters(spark, sf):
    e = _entries(spark, sf)
    pages = {"a": W.filtered(e, "document", "week"), "b": W.filtered(e, "other", name=" 1 ", indexed_only=True), "c": W.filtered(e, when="older")}
    out = None
    for name, page in pages.items():
        own = page.select("name", F.lit(name).alias("page"))
        out = own if out is None else out.unionByName(own)
    return out


@_register("filter_choices", """select doc_id, array_to_string(list_filter([case when doc_id % 4 = 0 then 'type:pdf' when doc_id % 4 = 1 then 'type:image' end, case when doc_id % 3 = 0 then 'after:2024-01-01' end,
  case doc_id % 5 when 0 then 'size:<1mb' when 1 then 'size:>1mb size:<10mb' when 2 then 'size:>10mb' end, case when doc_id % 2 = 0 then 'in:longer' end], lambda x: x is not null), ' ') as tokens from documents""")
def filter_choices(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    choices = d.select("doc_id", pick(4, "all", "image", "all", "all").alias("tab"), pick(4, "pdf", "", "", "").alias("type"), pick(3, "2024-01-01", "", "").alias("after"), F.lit("").alias("before"), pick(5, "small", "medium", "large", "", "").alias("size"), pick(2, " a longer b ", "").alias("folder"))
    return W.as_tokens(choices).select("doc_id", "tokens")


@_register("filter_description", f"""select * from (values (1, 'type pdf'), (2, 'larger than 2 KB'), (3, 'larger than 4.11133 KB'), (4, 'after 2024-01-10|before 2024-02-01'), (5, 'in “src1”'), (6, 'type image'), (7, 'type audio'), (8, ''), (9, 'type banana|smaller than 501 B'), (10, 'in “/src2/en”'),
  (11, 'type document|before 2024-01-15|larger than 1 KB|smaller than 3 KB'), (12, 'type video'), (13, '')) as t(query_id, told)""")
def filter_description(spark, sf):
    from heliograph.plans.search_queries import _filters

    return L.described(L.parse_queries(_filters(spark))).select("query_id", F.array_join("told", "|").alias("told"))


@_register("tier_sort", f"""with {RECORDS}, r as (select doc_id % 5 as query_id, doc_id, row_number() over (partition by doc_id % 5 order by doc_id) as rank, case when doc_id % 3 = 0 then 'strong' else 'weak' end as confidence, size from records),
k as (select *, row_number() over (partition by query_id, confidence order by rank) as m from r)
select query_id, doc_id, row_number() over (partition by query_id order by confidence <> 'strong', size desc, rank)::bigint as place from k where confidence = 'strong' or m <= 5""")
def tier_sort(spark, sf):
    r = _records(spark, sf).withColumn("query_id", F.col("doc_id") % 5)
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).withColumn("confidence", F.when(F.col("doc_id") % 3 == 0, "strong").otherwise("weak"))
    return W.sorted_in_tier(r.withColumn("name", T.filename("path")), "size", True).select("query_id", "doc_id", "place")


@_register("time_ago", f"""with {RECORDS}, a as (select doc_id, {NOW} - modified_time as s, modified_time from records)
select doc_id, case when s < 60 then 'just now' when s < 3600 then floor(s / 60)::bigint || case when floor(s / 60) = 1 then ' minute ago' else ' minutes ago' end when s < 86400 then floor(s / 3600)::bigint || case when floor(s / 3600) = 1 then ' hour ago' else ' hours ago' end
  when s < 60 * 86400 then floor(s / 86400)::bigint || case when floor(s / 86400) = 1 then ' day ago' else ' days ago' end else 'on ' || strftime(to_timestamp(modified_time) at time zone 'UTC', '%-d %B %Y') end as told from a""")
def time_ago(spark, sf):
    return _records(spark, sf).select("doc_id", W.ago(F.lit(NOW) - F.col("modified_time"), F.col("modified_time")).alias("told"))


@_register("keyframes", """with f as (select label as file_id, vec_id, row_number() over (partition by label order by vec_id) - 1 as i, count(*) over (partition by label) as n from embeddings),
s as (select *, greatest(1, pow(2, ceil(log2(n / 239.0::double))))::bigint as s from f), h as (select *, i // s as j, ceil(n / s::double) as m from s where i % s = 0)
select file_id, vec_id from h where j = 0 or floor(j * least(120, m) / m) > floor((j - 1) * least(120, m) / m)""")
def keyframes(spark, sf):
    return W.keyframes(read(spark, sf, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("t"))).select("file_id", F.col("t").alias("vec_id"))


@_register("blank_frames", """with p as (select vec_id, list_transform(embedding, lambda x: (abs(x::double) * (vec_id % 9) * 20)::int) as px from embeddings)
select vec_id, list_aggregate(px, 'quantile_cont', 0.99) < 16 and list_max(px) < 64 as blank from p""")
def blank_frames(spark, sf):
    pixels = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * (F.col("vec_id") % 9) * 20).cast("int"))
    return read(spark, sf, "embeddings").select("vec_id", W.blank(pixels).alias("blank"))


# -- evaluation ------------------------------------------------------------------------------------------------------

JUDGED = """pairs as (
  select q.vec_id as query_id, q.label = v.label and v.vec_id % 3 = 0 as relevant, row_number() over (partition by q.vec_id order by round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6), v.vec_id) as rank
  from embeddings v, (select * from embeddings where vec_id % 50 = 0) q where v.vec_id <> q.vec_id),
judged as (select *, sum(relevant::int) over (partition by query_id) as n_relevant from pairs)"""


def _judged(spark, sf):
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("own"))
    return R.judged(asked, v.select("vec_id", "embedding", "label", (F.col("vec_id") % 3 == 0).alias("may")))


@_register("retrieval_quality", f"""with {JUDGED}, by_q as (select query_id, n_relevant, sum((relevant and rank <= 5)::int) as in_5, sum((relevant and rank <= 10)::int) as in_10, min(case when relevant then rank end) as first, sum(case when relevant and rank <= 5 then 1 / log2(rank + 1) else 0 end) as dcg from judged group by all)
select count(*)::bigint as queries, round(avg(in_5 / n_relevant::double), 6) as recall_5, round(avg(in_10 / n_relevant::double), 6) as recall_10, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr,
  round(avg(dcg / list_sum(list_transform(range(1, least(n_relevant, 5)::bigint + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg_5 from by_q where n_relevant > 0""")
def retrieval_quality(spark, sf):
    return E.retrieval_quality(_judged(spark, sf))


@_register("latency", "with o as (select value as ms, row_number() over (order by value) - 1 as i, count(*) over () as n from events where value is not null) select max(case when i = n // 2 then ms end) as p50_ms, max(case when i = least(n - 1, ceil(n * 0.95::double) - 1) then ms end) as p95_ms, round(avg(ms), 6) as mean_ms from o")
def latency(spark, sf):
    return E.latency(read(spark, sf, "events"), "value")


@_register("routing_quality", f"""with {JUDGED}, r as (select query_id, n_relevant, min(case when relevant and rank <= 10 then rank end) as rank, sum((relevant and rank <= 5)::int) as in_5 from judged group by all)
select count(*)::bigint as queries, round(avg(coalesce(rank = 1, false)::int), 6) as hit_1, round(avg(coalesce(rank <= 5, false)::int), 6) as hit_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr,
  round(avg((n_relevant < 2 or in_5 >= n_relevant)::int), 6) as both_5, round(avg((query_id % 100 = 0)::int), 6) as embedded, round(avg((query_id % 150 = 0)::int), 6) as escalated from r""")
def routing_quality(spark, sf):
    by = _judged(spark, sf).groupBy("query_id", "n_relevant").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= 10), F.col("rank"))).alias("rank"), F.sum((F.col("relevant") & (F.col("rank") <= 5)).cast("int")).alias("in_5"))
    return E.routing_quality(by.withColumns({"embedded": F.col("query_id") % 100 == 0, "escalated": F.col("query_id") % 150 == 0}))


@_register("threshold_derivation", """with pairs as (select q.vec_id as query_id, case when q.label = v.label then 'relevant' else 'irrelevant' end as kind, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as d
  from embeddings v, (select * from embeddings where vec_id % 50 = 0) q where v.vec_id <> q.vec_id),
k as (select query_id, case when query_id % 100 = 0 then 'no_answer' else kind end as kind, d from pairs),
b as (select query_id, min(case when kind = 'relevant' then d end) as rel, min(case when kind = 'irrelevant' then d end) as irr, min(case when kind = 'no_answer' then d end) as none from k group by query_id)
select round(greatest(quantile_cont(rel, 0.98), quantile_cont(none, 0.6)), 3) as cutoff, round(quantile_cont(rel, 0.9) - 0.05 * (quantile_cont(rel, 0.9) - quantile_cont(rel, 0.1)), 3) as strong_with_literal, round(quantile_cont(rel, 0.9), 3) as strong_meaning_only,
  round(least(greatest(quantile_cont(irr - rel, 0.5) * 0.25, 0.02::double), 0.2::double), 3) as gap from b""")
def threshold_derivation(spark, sf):
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("own"))
    hits = R.judged(asked, v.select("vec_id", "embedding", "label", F.lit(True).alias("may")), 1)
    kind = F.when(F.col("query_id") % 100 == 0, "no_answer").when(F.col("relevant"), "relevant").otherwise("irrelevant")
    return E.thresholds(hits.select(kind.alias("kind"), "query_id", "distance"))


@_register("component_scores", """with c as (select doc_id, case when doc_id % 2 = 0 then (doc_id % 10) / 10.0::double end as a, case when doc_id % 3 <> 0 then 0.5::double end as r, case when doc_id % 5 = 0 then 0.25::double end as g, doc_id % 40 as n from documents),
w as (select *, (case when a is not null then 0.35::double else 0 end + case when r is not null then 0.25::double else 0 end + case when g is not null then 0.15::double else 0 end) as w from c)
select doc_id, round((coalesce(a, 0) * 0.35::double + coalesce(r, 0) * 0.25::double + coalesce(g, 0) * 0.15::double) / nullif(w, 0) * 100 * case when n < 20 then 0.5 + 0.5 * n / 20.0::double else 1 end, 1) as score from w""")
def component_scores(spark, sf):
    d = F.col("doc_id")
    score = E.component_score(d % 40, accuracy=F.when(d % 2 == 0, (d % 10) / 10), reliability=F.when(d % 3 != 0, 0.5), grounding=F.when(d % 5 == 0, 0.25))
    return read(spark, sf, "documents").select("doc_id", score.alias("score"))


# -- answers ---------------------------------------------------------------------------------------------------------


@_register("source_numbers", """with hits as (select item_id as question_id, ((item_id * 7 + k * 3) % 11)::varchar as file_id, k // 4 as turn, k % 4 as rank from benchmark, (select unnest(range(0, 12)) as k)),
firsts as (select question_id, file_id, min((turn, rank)) as first from hits group by all)
select question_id, file_id, row_number() over (partition by question_id order by first, file_id)::bigint as number from firsts""")
def source_numbers(spark, sf):
    hits = read(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    found = hits.select("question_id", ((F.col("question_id") * 7 + F.col("k") * 3) % 11).cast("string").alias("file_id"), F.floor(F.col("k") / 4).alias("turn"), (F.col("k") % 4).alias("rank"), F.lit("text").alias("text"))
    return A.numbered(found).select("question_id", "file_id", "number")


@_register("names_with_all", f"""with {RECORDS}, asked as (select distinct 'doc ' || (doc_id % 100) as name, doc_id % 100 as n from records where doc_id % 50 = 0)
select name, path from asked, records where not deleted and contains(replace(lower({NAME}), '_', ' '), 'doc') and contains(replace(lower({NAME}), '_', ' '), n::varchar)""")
def names_with_all(spark, sf):
    r = _records(spark, sf)
    return A.names_with_all(r.where("doc_id % 50 = 0").select(F.concat(F.lit("doc "), (F.col("doc_id") % 100).cast("string")).alias("name")).distinct(), r)


@_register("names_raw_or_corrected", f"""with {RECORDS}, a as (select 1 as query_id, doc_id from records where not deleted and doc_id % 3 = 0), b as (select 1 as query_id, doc_id from records where not deleted and doc_id % 2 = 0)
select query_id, doc_id, 'corrected' as by_ from a union all select query_id, doc_id, 'raw' from b where doc_id not in (select doc_id from a)""")
def names_raw_or_corrected(spark, sf):
    r = _records(spark, sf).where("not deleted").select(F.lit(1).alias("query_id"), "doc_id")
    return R.first_of(r.where("doc_id % 3 = 0").withColumn("by_", F.lit("corrected")), r.where("doc_id % 2 = 0").withColumn("by_", F.lit("raw")))


@_register("premise_years", "select doc_id, case when doc_id % 3 = 0 and not contains(lower(text), '2024') then 'the sources never mention 2024' end as problem from documents where text is not null")
def premise_years(spark, sf):
    d = read(spark, sf, "documents").where("text is not null")
    question = F.when(F.col("doc_id") % 3 == 0, "what happened in 2024").otherwise("what happened")
    return d.select("doc_id", A.premise_problem(question, F.col("text")).alias("problem"))


@_register("kept_filters", """select doc_id, array_to_string(list_filter([case when doc_id % 2 = 0 then 'type:pdf' end, case when doc_id % 3 = 0 then 'after:2023-01' end], lambda x: x is not null), ' ') as kept from documents""")
def kept_filters(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    question = F.concat(F.when(F.col("doc_id") % 2 == 0, "the pdf ").otherwise("the report "), F.when(F.col("doc_id") % 3 == 0, "of 2023").otherwise("of last year"))
    return W.kept_filters(d.withColumns({"filters": F.lit("type:pdf after:2023-01 size:>1mb"), "question": question})).select("doc_id", "kept")


@_register("nfd_length", "select doc_id, length(t)::bigint as n from (select doc_id, nfc_normalize(text) as t from documents where text is not null)")
def nfd_length(spark, sf):
    """Decomposed and composed again."""
    d = read(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.length(T.nfc(T.nfd("text"))).cast("long").alias("n"))


@_register("citations")
def citations(spark, sf):
    """Answers made of two passages, cited with a third: each question's own passages stay."""
    hits = R.bm25_relaxed(text_queries(spark, sf), index(spark, sf), 3).join(index(spark, sf).chunks().select("chunk_id", "content"), "chunk_id")
    sources = hits.select(F.col("query_id").alias("question_id"), F.col("rank").alias("number"), F.col("content").alias("text"))
    answers = sources.where("number <= 2").groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda s: F.substring(s["text"], 1, 80)), " ").alias("answer"))
    return A.trimmed_citations(answers.withColumn("cited", F.array(*[F.lit(n).cast("long") for n in (3, 1, 2)])), sources).select("question_id", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"))
