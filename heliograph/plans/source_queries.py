"""Registered queries on sources and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.fixtures import RECORDS, USAGE, file_records, read, usage_events
from heliograph.sources.extract import extract
from heliograph.sources.links import contained
from heliograph.sources.sound import sound_windows
from heliograph.sources.tables import shared_folder
from heliograph.sources.scan import admitted, chunk_cap, scan_order, size_cap
from heliograph.sources.transcripts import token_chunks
from heliograph.streaming.events import apply_file_events, changed_files, debounce_stream, session_stream
from heliograph.streaming.stateful import FileEventSink, debounced, live_sessions, state_store

Q: dict = {}
SQL: dict[str, str] = {}


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@_register("html_text_len")
def html_text_len(spark, sf):
    pages = read(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return extract(pages).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("page_id"), F.length("text").cast("long").alias("n_chars"), "error")


@_register("admission", f"""with {RECORDS}, l as (select case when doc_id % 37 = 0 then replace(path, '/doc_', '/node_modules/doc_') when doc_id % 41 = 0 then replace(path, '/doc_', '/.doc_') else path end as path, case when doc_id % 43 = 0 then size + 6000000 else size end as size, ext from records)
select path, case when path like '%/node_modules/%' then 'folder' when path like '%/.doc_%' then 'hidden' when ext in ('jpg', 'mp4') then 'type' when size > 5242880 and ext in ('md', 'txt', 'csv', 'py', 'html') then 'size' end as skip from l""")
def admission(spark, sf):
    r = file_records(spark, sf)
    path = F.when(F.col("doc_id") % 37 == 0, F.replace("path", F.lit("/doc_"), F.lit("/node_modules/doc_"))).when(F.col("doc_id") % 41 == 0, F.replace("path", F.lit("/doc_"), F.lit("/.doc_"))).otherwise(F.col("path"))
    size = F.when(F.col("doc_id") % 43 == 0, F.col("size") + 6_000_000).otherwise(F.col("size"))
    return admitted(r.select(path.alias("path"), size.alias("size")), "/").select("path", "skip")


@_register("link_containment", f"""with recursive {RECORDS}, made as (select '/links/l' || doc_id as path, case when doc_id % 70 = 0 then '/links/l' || doc_id || '/again' when doc_id % 30 = 0 then '/links/l' || (doc_id + 10) when doc_id % 40 = 0 then '/links/l' || (doc_id - 40) || '/deep' else regexp_replace(path, '/[^/]*$', '') end as target from records where doc_id % 10 = 0),
asked as (select '/links/l' || (doc_id - doc_id % 10) || '/doc_' || doc_id as path from records union all select path from records where doc_id % 5 = 1),
walk as (select path, path as real, 0 as n from asked
  union all select w.path, s.real, n + 1 from walk w, lateral (select m.target || substr(w.real, length(m.path) + 1) as real from made m where w.real = m.path or starts_with(w.real, m.path || '/') order by length(m.path) limit 1) s where n <= 8),
last as (select path, arg_max(real, n) as real, max(n) as n from walk group by path)
select path, case when n <= 8 then real end as real, coalesce(n <= 8 and (starts_with(real, '/src1/') or starts_with(real, '/src3/')), false) as inside from last""")
def link_containment(spark, sf):
    """Links into folders of the collection, chains of them and some that go in circles."""
    r, d = file_records(spark, sf), F.col("doc_id")
    at = lambda n: F.concat(F.lit("/links/l"), n.cast("string"))
    target = F.when(d % 70 == 0, F.concat(at(d), F.lit("/again"))).when(d % 30 == 0, at(d + 10)).when(d % 40 == 0, F.concat(at(d - 40), F.lit("/deep"))).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    links = r.where(d % 10 == 0).select(at(d).alias("path"), target.alias("target"))
    asked = r.select(F.concat(at(d - d % 10), F.lit("/doc_"), d.cast("string")).alias("path")).union(r.where(d % 5 == 1).select("path"))
    return contained(asked, spark.createDataFrame([("/src1",), ("/src3/",)], "root string"), links, 8)


@_register("sound_windows", """with recursive made as (select label, vec_id, case when (vec_id // 8) % 3 = 0 then list_transform(embedding, lambda x: 0.0::double) else embedding end as v from embeddings where embedding is not null),
numbered as (select label, x, row_number() over (partition by label order by vec_id, j) - 1 as i from (select label, vec_id, unnest(v)::double as x, generate_subscripts(v, 1) as j from made)),
e as (select label, i, x * x as e, x * x + lead(x * x) over (partition by label order by i) as two, count(*) over (partition by label) as n from numbered),
walk as (select label, 0::bigint as start, max(n) as n, case when max(n) > 600 then arg_min(i + 1, (two, i)) filter (where i between 540 and 598) else max(n) end as stop, 1 as k from e group by label
  union all select w.label, w.stop, w.n, case when w.stop + 600 < w.n then f.middle else w.n end, w.k + 1 from walk w, lateral (select arg_min(e.i + 1, (e.two, e.i)) as middle from e where e.label = w.label and e.i between w.stop + 540 and w.stop + 598) f where w.stop < w.n)
select w.label as sound_id, w.k::bigint as window, w.start, w.stop as "end", round(sqrt(sum(e.e) / (w.stop - w.start)), 6) as rms from walk w join e on e.label = w.label and e.i >= w.start and e.i < w.stop group by w.label, w.k, w.start, w.stop having sqrt(sum(e.e) / (w.stop - w.start)) >= 1e-4""")
def sound_windows_query(spark, sf):
    """Vectors of a label one after another as a sound of twenty samples a second, a third of it silent."""
    v = read(spark, sf, "embeddings").where("embedding is not null")
    quiet = F.when(F.floor(F.col("vec_id") / 8) % 3 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return sound_windows(v.select(F.col("label").alias("sound_id"), F.col("vec_id").alias("block"), quiet.alias("samples")), 20).withColumn("rms", F.round("rms", 6))


@_register("caps_and_order", f"""with {RECORDS} select doc_id, case when ext in ('md', 'txt', 'csv', 'py', 'html') then 5242880 when ext in ('pdf', 'docx') then 52428800 end::bigint as size_cap,
  case when ext in ('py', 'csv') then 8 when ext in ('txt', 'md', 'html') then 40 when ext = 'mp3' then null else 150 end::bigint as chunk_cap, case when ext = 'mp4' then 4 when ext = 'mp3' then 3 when ext = 'jpg' then 2 when ext in ('py', 'csv') then 1 else 0 end::bigint as scan_order from records""")
def caps_and_order(spark, sf):
    e = F.col("ext")
    return file_records(spark, sf).select("doc_id", size_cap(e).cast("long").alias("size_cap"), chunk_cap(e).cast("long").alias("chunk_cap"), scan_order(e).cast("long").alias("scan_order"))


@_register("token_chunks")
def token_chunk_counts(spark, sf):
    windows = token_chunks(read(spark, sf, "documents"), lambda w: 1 + len(w) // 4)
    return windows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("end_offset").alias("last"))


@_register("session_stream", f"""with {USAGE}, n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= 1800 then 0 else 1 end as fresh from usage)),
s as (select user_id, s, max(ts) as last, count(*) as events from n group by all)
select user_id, events::bigint as events, count(*)::bigint as sessions from s where last + 1800 <= (select max(ts) from usage) - 3600 group by user_id, events""")
def sessions_by_stream(spark, sf):
    """Sessions that the stream has closed by its watermark, counted by their size."""
    events = usage_events(spark, sf).select("user_id", "kind", F.col("at").alias("ts"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = session_stream(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("user_id", "events").agg(F.count("*").alias("sessions"))


def _streamed(spark, rows, transform, by=None, times=1, sink=None, tries=1):
    """Rows of a stream that reads a table and ends. With `by` the table arrives in so many slices of equal ranges of that
    column; the stream is started for each and goes on from its checkpoint. sink: for foreachBatch, in place of files; a
    start that fails is tried again."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(by), F.max(by)).first() if by else (0, 0)
    slice_ = F.least(F.floor((F.col(by) - low) * times / max(high - low, 1)), F.lit(times - 1)) if by else F.lit(0)
    for k in range(times):
        rows.where(slice_ == k).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        out = out.format("parquet").option("path", f"{folder}/out") if sink is None else out.foreachBatch(sink)
        for left in reversed(range(tries)):
            try:
                with state_store(spark):
                    out.start().awaitTermination()
                break
            except StreamingQueryException:
                if not left:
                    raise
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if sink is None else None


@_register("event_stream", f"""with {USAGE}, b as (select user_id, event_id, ts, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from usage)
select user_id, event_id, (sum(case when before is null or ts - before > 1800 then 1 else 0 end) over (partition by user_id order by event_id))::bigint as session from b""")
def event_stream(spark, sf):
    """All users' events in the order of arrival, by a stream that is stopped and started again."""
    events = usage_events(spark, sf).select("user_id", "event_id", "ts")
    return _streamed(spark, events, live_sessions, "event_id", 3).select("user_id", "event_id", "session")


@_register("debounced_events", f"""with {USAGE}, n as (select user_id, moment, ts, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= 600 then 0 else 1 end as fresh from usage)),
s as (select user_id, s, max(ts) as last, count(*) as events from n group by all)
select user_id, events::bigint as events, count(*)::bigint as waits from s where last + 600 <= (select max(ts) from usage) - 60 group by user_id, events""")
def debounced_events(spark, sf):
    """What a stream tells once a key has been quiet for ten minutes."""
    events = usage_events(spark, sf).select(F.col("user_id").alias("path"), "kind", F.col("at").alias("ts"))
    done = _streamed(spark, events, lambda stream: debounce_stream(stream, "10 minutes"))
    return done.groupBy(F.col("path").alias("user_id"), "events").agg(F.count("*").alias("waits"))


@_register("debounce_cancel", f"""with {USAGE}, f as (select *, kind in ('file_revealed', 'recommendation_clicked') as cancels, lag(kind in ('file_revealed', 'recommendation_clicked')) over w as after_cancel, ts - lag(ts) over w as gap from usage window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(case when gap is null or gap > 1800 or after_cancel then 1 else 0 end) over (partition by user_id order by ts, event_id) as wait from f),
w as (select user_id, wait, max(ts) as last, arg_max(kind, (ts, event_id)) as kind, count(*) as events, bool_or(cancels) as cancelled from n group by user_id, wait)
select user_id, kind, events::bigint as events, count(*)::bigint as waits from w where not cancelled and last + 1800 <= (select max(ts) from usage) - 60 group by all""")
def debounce_cancel(spark, sf):
    """Users who were quiet for half an hour, but for waits that one of two kinds took away."""
    events = usage_events(spark, sf).select(F.col("user_id").alias("path"), "event_id", "kind", F.col("at").alias("ts"), F.unix_seconds("at").alias("second"))
    done = _streamed(spark, events, lambda stream: debounced(stream, 1800, ("file_revealed", "recommendation_clicked")), "second", 3)
    return done.groupBy(F.col("path").alias("user_id"), "kind", "events").agg(F.count("*").alias("waits"))


@_register("file_event_stream", f"""with {RECORDS}, a as (select doc_id, path, case when doc_id % 5 = 0 then 'first-' || doc_id else hash end as hash, deleted and doc_id % 5 <> 0 as deleted from records),
b as (select doc_id, path, hash, deleted or doc_id % 3 = 0 as deleted from a),
c as (select doc_id, path, case when doc_id % 6 = 0 and doc_id % 12 <> 0 then 'third-' || doc_id else hash end as hash, deleted and not (doc_id % 6 = 0 and doc_id % 12 <> 0) as deleted from b)
select case when doc_id % 7 = 1 and not deleted then path || '.moved' else path end as path, hash, deleted, 0::bigint as dead from c
union all select path, 'bad-' || doc_id as hash, null as deleted, 1 as dead from records where doc_id % 12 = 0""")
def file_event_stream(spark, sf):
    """Four batches of file events (changes, deletions, changes of which some are poisoned, moves). The third is lost
    once after it has been applied, and runs again; a batch with the second's number is sent once more at the end."""
    r = file_records(spark, sf, hashed=True)
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    said = lambda word: F.concat(F.lit(word), d.cast("string"))
    events = [
        r.where(d % 5 == 0).select("path", F.lit("modified").alias("kind"), said("first-").alias("hash"), none.alias("target"), F.lit(0).cast("long").alias("version")),
        r.where(d % 3 == 0).select("path", F.lit("deleted"), none, none, F.lit(1).cast("long")),
        r.where(d % 6 == 0).select("path", F.lit("created"), F.when(d % 12 == 0, said("bad-")).otherwise(said("third-")), none, F.lit(2).cast("long")),
        r.where(d % 7 == 1).select("path", F.lit("moved"), "hash", F.concat("path", F.lit(".moved")), F.lit(3).cast("long")),
    ]
    poisoned = r.where(d % 12 == 0).select(said("bad-").alias("hash"))
    sink = FileEventSink(f"{shared_folder(spark)}/{uuid.uuid4().hex}", r, poisoned=poisoned)
    every = reduce(DataFrame.union, events)
    failed = []

    def once(batch, number):
        sink(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost before the stream knew that the batch was done")

    _streamed(spark, every, lambda stream: stream, "version", 4, once, tries=2)
    sink(events[0], 1)  # a number that is done
    live = sink.records().select("path", "hash", "deleted", F.lit(0).cast("long").alias("dead"))
    return live.unionByName(sink.dead_letters().select("path", "hash", F.lit(None).cast("boolean").alias("deleted"), F.lit(1).cast("long").alias("dead")))


@_register("changed_files", f"with {RECORDS} select path from records where doc_id % 4 in (0, 1) and (deleted or doc_id % 4 = 0)")
def changed_files_query(spark, sf):
    r = file_records(spark, sf, hashed=True)
    kind = F.when(F.col("doc_id") % 4 == 2, "deleted").when(F.col("doc_id") % 2 == 0, "modified").otherwise("created")
    events = r.where("doc_id % 4 <> 3").select("path", kind.alias("kind"), F.when(F.col("doc_id") % 4 == 0, F.lit("changed")).otherwise(F.col("hash")).alias("hash"))
    return changed_files(events, r.select("path", "hash", "deleted")).select("path")


@_register("file_events", f"""with {RECORDS}, scoped as (select * from records where doc_id % 10 <> 9)
select path, hash, deleted from (
  select case when path like '/src1/en/%' and not deleted then replace(path, '/src1/en/', '/src1/moved/') when path like '/src2/%' and not deleted then path else path end as path,
    case when doc_id % 10 = 4 then 'changed' else hash end as hash,
    case when doc_id % 10 = 4 then false when path like '/src2/%' or path like '/src3/de/%' then true else deleted end as deleted from scoped where not (path like '/src1/en/%' and doc_id % 10 = 4)
  union all select replace(path, '/src1/en/', '/src1/moved/'), hash, deleted from scoped where path like '/src1/en/%' and doc_id % 10 = 4 and not deleted
  union all select path, hash, deleted from scoped where path like '/src1/en/%' and doc_id % 10 = 4 and deleted and false
  union all select path, 'changed', false from scoped where path like '/src1/en/%' and doc_id % 10 = 4)""")
def file_events(spark, sf):
    """A folder moves within its root, another out of all roots, a third is deleted, and files change."""
    r = file_records(spark, sf, hashed=True).where("doc_id % 10 <> 9")
    folders = spark.createDataFrame([("/src1/en", "moved", None, "/src1/moved", 5), ("/src2", "moved", None, "/elsewhere", 6), ("/src3/de", "deleted", None, None, 7)], "path string, kind string, hash string, target string, version long")
    files = r.where("doc_id % 10 = 4").select("path", F.lit("modified").alias("kind"), F.lit("changed").alias("hash"), F.lit(None).cast("string").alias("target"), F.lit(8).cast("long").alias("version"))
    roots = spark.createDataFrame([(f"/src{i}",) for i in range(100)], "root string")
    return apply_file_events(r.select("file_id", "path", "hash", "deleted"), folders.unionByName(files), roots).select("path", "hash", "deleted")
