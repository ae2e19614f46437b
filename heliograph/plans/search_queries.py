"""Registered queries on the query language, names, spelling, routing and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.config import NAME_GENERIC, NAME_NOISE, QUESTION_WORDS, STOP_WORDS
from heliograph.fixtures import CHUNKS, QUERIES, RECORDS, file_records, index, read, text_queries, tokens_sql
from heliograph.functions import text as T
from heliograph.operators import filters as L
from heliograph.operators import names as N
from heliograph.operators import ranking as K
from heliograph.operators import retrieval as R
from heliograph.plans.retrieval_queries import BM25, RANKED

Q: dict = {}
SQL: dict[str, str] = {}


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# query, and what it should be parsed to: words, phrase, type, after, before, smallest, largest, path
FILTERS = [
    (1, "type:pdf report", "report", None, "pdf", None, None, None, None, None),
    (2, "size:>2kb", "", None, None, None, None, 2048, None, None),
    (3, "SIZE:>=4211", "", None, None, None, None, 4210, None, None),
    (4, "after:2024-01-10 before:2024-02", "", None, None, 1704844800.0, 1706745600.0, None, None, None),
    (5, "in:SRC1", "", None, None, None, None, None, None, "src1"),
    (6, "ext:photos", "", None, "image", None, None, None, None, None),
    (7, "type:audio", "", None, "audio", None, None, None, None, None),
    (8, '"the quick"', "the quick", "the quick", None, None, None, None, None, None),
    (9, "size:<=500b type:banana", "", None, "banana", None, None, None, 501, None),
    (10, 'after:nonsense in:"/src2/en" plan', "plan", None, None, None, None, None, None, "/src2/en"),
    (11, "before:2024-01-15 size:1kb size:<3kb type:documents", "", None, "document", None, 1705276800.0, 1024, 3072, None),
    (12, "type:video", "", None, "video", None, None, None, None, None),
    (13, "size:huge", "", None, None, None, None, None, None, None),
]


def _lit(v):
    return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


PARSED = "parsed as (select * from (values " + ", ".join("(" + ", ".join(map(_lit, (r[0], *r[2:]))) + ")" for r in FILTERS) + ") as t(query_id, words, phrase, file_type, after, before, size_min, size_max, path_contains))"
# of the sample records' extensions (md txt pdf docx csv py jpg mp3 mp4 html), stated by hand
GROUPS = """type_groups as (select * from (values ('document', 'md'), ('document', 'txt'), ('document', 'pdf'), ('document', 'docx'), ('document', 'csv'), ('document', 'py'), ('document', 'html'),
  ('image', 'jpg'), ('jpg', 'jpg'), ('jpeg', 'jpg'), ('audio', 'mp3'), ('video', 'mp4'), ('spreadsheet', 'csv'), ('code', 'py'), ('word', 'docx'), ('text', 'txt'), ('text', 'md')) as t(kind, e))"""
MATCHED = f"""{RECORDS}, {PARSED}, {GROUPS},
matched as (
  select query_id, doc_id, path, modified_time, size from records r, parsed p
  where not deleted
    and (file_type is null or case when coalesce(audio_only, false) and file_type in ('audio', 'video') then file_type = 'audio'
         else ext = file_type and file_type not in (select kind from type_groups) or (file_type, ext) in (select (kind, e) from type_groups) end)
    and coalesce(modified_time >= after, true) and coalesce(modified_time < before, true) and coalesce(size > size_min, true)
    and coalesce(size < size_max, true) and coalesce(contains(lower(path), path_contains), true))"""


def _filters(spark, *only) -> DataFrame:
    rows = [r for r in FILTERS if not only or r[0] in only]
    return spark.sql("select * from values " + ", ".join(f"({r[0]}L, {_lit(r[1])})" for r in rows) + " as t(query_id, query)")


@_register("parse_queries", f"with {PARSED} select query_id, words, phrase, file_type, after::double as after, before::double as before, size_min::bigint as size_min, size_max::bigint as size_max, path_contains from parsed")
def parse_queries(spark, sf):
    return L.parse_queries(_filters(spark))


for _name, _ids in (("type_group_filter", (1, 6, 7, 9, 12)), ("size_filter_boundary", (2, 3, 9)), ("date_range_filter", (4, 11)), ("path_contains", (5, 10)), ("doc_metadata_filter", tuple(r[0] for r in FILTERS))):

    def _matches(spark, sf, ids=_ids):
        return L.matching(file_records(spark, sf), L.parse_queries(_filters(spark, *ids))).select("query_id", "doc_id")

    _register(_name, f"with {MATCHED} select query_id, doc_id from matched where query_id in {_ids}")(_matches)


@_register("filters_only_newest", f"with {MATCHED} select query_id, doc_id, rank::bigint as rank from (select *, row_number() over (partition by query_id order by modified_time desc, doc_id) as rank from matched) where rank <= 10")
def filters_only_newest(spark, sf):
    return L.newest(L.matching(file_records(spark, sf), L.parse_queries(_filters(spark))), 10).select("query_id", "doc_id", "rank")


@_register("folder_scope", f"with {RECORDS} select doc_id, path from records where lower(path) like '/src1/%' and not deleted")
def folder_scope(spark, sf):
    return file_records(spark, sf).where(F.lower("path").startswith("/src1/") & ~F.col("deleted")).select("doc_id", "path")


@_register("kind_counts", f"""with {RECORDS} select kind, count(*)::bigint as n from (select case when ext in ('jpg') then 'image' when ext = 'mp3' or (ext = 'mp4' and coalesce(audio_only, false)) then 'audio' when ext = 'mp4' then 'video'
  when ext = 'py' then 'code' else 'document' end as kind from records) group by kind""")
def kind_counts(spark, sf):
    return file_records(spark, sf).groupBy(L.kind_of(F.col("ext"), F.col("audio_only")).alias("kind")).agg(F.count("*").alias("n"))


@_register("size_text", f"""with {RECORDS} select doc_id, case when n >= 1073741824 then printf('%g', n / 1073741824.0::double) || ' GB' when n >= 1048576 then printf('%g', n / 1048576.0::double) || ' MB' when n >= 1024 then printf('%g', n / 1024.0::double) || ' KB' else n || ' B' end as said
from (select doc_id, size * (doc_id + 1) as n from records)""")
def size_text(spark, sf):
    return file_records(spark, sf).withColumn("size", F.col("size") * (F.col("doc_id") + 1)).select("doc_id", T.human_size("size").alias("said"))


NAMES = [(1, "open the doc 17 file"), (2, "doc_42.pdf"), (3, "doc 7"), (4, "notes"), (5, "src7 doc"), (6, "find document 12"), (7, "document"), (8, "docs about 100 html"), (9, "doc"), (10, "please show 4 csv"), (11, ""), (12, "dok 31 txt")]
NAME_QUERIES = "nq as (select * from (values " + ", ".join(f"({i}, {_lit(t)})" for i, t in NAMES) + ") as t(query_id, query))"
NAME_MATCH = f"""{RECORDS}, {NAME_QUERIES},
raw as (select query_id, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) >= 2 and not list_contains({NAME_NOISE}, w)) as w, regexp_extract_all(lower(query), '\\.([a-z0-9]+)\\b', 1) as typed from nq),
pick as (select query_id, w, typed, list_filter(w, lambda x: not list_contains({NAME_GENERIC}, x) and not list_contains(typed, x)) as specific from raw),
used as (select query_id, case when len(specific) > 0 then list_concat(specific, list_filter(w, lambda x: list_contains(typed, x))) else w end as w from pick),
nwords as (select query_id, len(w) as n_words, unnest(w) as word, generate_subscripts(w, 1) as place from used where len(w) > 0),
ntoks as (select doc_id, path, ext, unnest(case when ext = 'mp3' or coalesce(audio_only, false)
   then list_concat(regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '')), '[a-z0-9]+'), regexp_extract_all(lower(split_part(path, '/', -2)), '[a-z0-9]+'))
   else regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '')), '[a-z0-9]+') end) as token from records where not deleted),
nhits as (select distinct query_id, n_words, place, word, doc_id, path, ext from nwords, ntoks
  where token = word or (length(word) >= 4 and starts_with(token, word)) or (length(word) >= 6 and abs(length(token) - length(word)) <= 1 and levenshtein(word, token) <= 1)),
nmet as (select h.query_id, h.n_words, doc_id, path, count(*) + max(case when ext in (select word from nwords w where w.query_id = h.query_id) and ext not in (select word from nhits g where g.query_id = h.query_id and g.doc_id = h.doc_id) then 1 else 0 end) as matched
  from nhits h group by all),
named as (select query_id, doc_id, path, matched, n_words, round(matched / n_words::double, 6) as coverage from nmet where matched * 2 >= n_words and (matched >= 2 or n_words = 1))"""


def _name_queries(spark) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"({i}L, {_lit(t)})" for i, t in NAMES) + " as t(query_id, query)")


@_register("filename_match", f"with {NAME_MATCH} select query_id, doc_id, path, matched::bigint as matched, n_words::bigint as n_words, coverage from named")
def filename_match(spark, sf):
    return N.match_filenames(_name_queries(spark), file_records(spark, sf))


@_register("name_over_content", f"""with {NAME_MATCH}, content as (select query_id, doc_id from nq, records where doc_id % 50 = query_id),
firsts as (select query_id, doc_id, 0 as band, coverage, matched, lower(regexp_extract(path, '[^/]*$', 0)) as nm from named),
rest as (select query_id, doc_id, 1 as band, 0.0 as coverage, 0 as matched, '' as nm from content c where not exists (select 1 from named n where n.query_id = c.query_id and n.doc_id = c.doc_id))
select query_id, doc_id, band, rank::bigint as rank from (select *, row_number() over (partition by query_id order by band, coverage desc, matched desc, nm, doc_id) as rank from (select * from firsts union all select * from rest)) where rank <= 10""")
def name_over_content(spark, sf):
    """Name matches stand before content results, which leave out files listed already."""
    from pyspark.sql import Window

    queries, records = _name_queries(spark), file_records(spark, sf)
    names = N.match_filenames(queries, records)
    content = records.join(queries, F.col("doc_id") % 50 == F.col("query_id")).select("query_id", "doc_id").join(names, ["query_id", "doc_id"], "left_anti")
    first = names.select("query_id", "doc_id", F.lit(0).alias("band"), "coverage", "matched", F.lower(T.filename("path")).alias("name"))
    rest = content.select("query_id", "doc_id", F.lit(1).alias("band"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("matched"), F.lit("").alias("name"))
    line = Window.partitionBy("query_id").orderBy("band", F.desc("coverage"), F.desc("matched"), "name", "doc_id")
    return first.union(rest).withColumn("rank", F.row_number().over(line).cast("long")).where("rank <= 10").select("query_id", "doc_id", "band", "rank")


VOCAB = f"{CHUNKS}, {QUERIES}, vocab as (select term, count(*) as occurrences from (select unnest({tokens_sql('content')}) as term from chunks) where length(term) >= 3 and regexp_full_match(term, '[a-z]+') group by term)"
TYPOS = f"""typos as (select distinct case when i % 3 = 0 then substr(w, 1, 2) || substr(w, 4) when i % 3 = 1 then substr(w, 1, 3) || 'q' || substr(w, 4) else substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) end as word
  from (select query_id as i, unnest({tokens_sql('query')}) as w from queries) where regexp_full_match(w, '[a-z]{{4,}}'))"""


def _vocab(spark, sf) -> DataFrame:
    return index(spark, sf).vocabulary().where(F.col("term").rlike("^[a-z]+$"))


def _typos(spark, sf) -> DataFrame:
    w = text_queries(spark, sf).select(F.col("query_id").alias("i"), F.explode(T.tokens("query")).alias("w")).where(F.col("w").rlike("^[a-z]{4,}$"))
    part = lambda a, n=100: F.substring("w", a, n)
    typo = F.when(F.col("i") % 3 == 0, F.concat(part(1, 2), part(4))).when(F.col("i") % 3 == 1, F.concat(part(1, 3), F.lit("q"), part(4))).otherwise(F.concat(part(1, 1), part(3, 1), part(2, 1), part(4)))
    return w.select(typo.alias("word")).distinct()


# edit distances of the oracle count bytes: accented letters of the asked words become single signs that no term has
BYTEWISE = "translate(word, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"
CLOSEST = f"""
near as (
  select word, term, occurrences, levenshtein({BYTEWISE}, term) as distance, not (starts_with(term, word) or starts_with(word, term)) as apart
  from asked, vocab where abs(length(term) - length(word)) <= 2 and levenshtein({BYTEWISE}, term) <= case when starts_with(term, word) or starts_with(word, term) or length(word) >= 7 then 2 else 1 end),
closest as (select word, term as correction, distance from (select *, row_number() over (partition by word order by apart, distance, occurrences desc, term) as n from near) where n = 1)"""
SWAPS = """
swaps as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) as term
  from (select word, unnest(range(1, length(word))) as i from typos where length(word) between 4 and 5)),
swapped as (select word, term as correction from (select s.word, s.term, row_number() over (partition by s.word order by occurrences desc, i) as n from swaps s join vocab using (term) where s.term <> s.word) where n = 1)"""


@_register("spell_closest", f"with {VOCAB}, {TYPOS}, asked as (select word from typos where length(word) >= 6), {CLOSEST} select word, correction, distance::bigint as distance from closest")
def spell_closest(spark, sf):
    return N.closest_word(_typos(spark, sf).where(F.length("word") >= 6), _vocab(spark, sf))


@_register("spell_swap", f"with {VOCAB}, {TYPOS}, {SWAPS} select word, correction from swapped")
def spell_swap(spark, sf):
    return N.swapped_word(_typos(spark, sf), _vocab(spark, sf))


PLURALS = """plurals as (select distinct word from plurals_of where (word like '%ies' and substr(word, 1, length(word) - 3) || 'y' in (select term from vocab)) or (word like '%es' and substr(word, 1, length(word) - 2) in (select term from vocab))
  or (word like '%s' and substr(word, 1, length(word) - 1) in (select term from vocab)))"""


@_register("plural_known", f"with {VOCAB}, plurals_of as (select term as word from vocab), {PLURALS} select word from plurals")
def plural_known(spark, sf):
    vocab = _vocab(spark, sf)
    return N.plural_of_known(vocab.select(F.col("term").alias("word")), vocab)


@_register("correct_queries", f"""with {VOCAB}, wq as (select query_id, replace(query, 'e', 'ee') as query from queries),
parts as (select query_id, unnest(p) as part, generate_subscripts(p, 1) as i from (select query_id, regexp_extract_all(query, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') as p from wq)),
typos as (select distinct lower(part) as word from parts where regexp_full_match(part, '\\p{{L}}+') and lower(part) not in (select term from vocab)),
plurals_of as (select word from typos), {PLURALS}, asked as (select word from typos where length(word) >= 6 and word not in (select word from plurals)), {CLOSEST},
{SWAPS},
fixed as (select word, correction from closest union all select word, correction from swapped where word not in (select word from plurals))
select query_id, string_agg(coalesce(correction, part), '' order by i) as corrected from parts left join fixed on word = lower(part) group by query_id""")
def correct_queries(spark, sf):
    """Queries with a letter doubled."""
    queries = text_queries(spark, sf).select("query_id", F.replace("query", F.lit("e"), F.lit("ee")).alias("query"))
    return N.correct_queries(queries, _vocab(spark, sf))


@_register("unrecognised")
def unrecognised(spark, sf):
    return N.unrecognised(text_queries(spark, sf).unionByName(_typos(spark, sf).select((-F.abs(F.xxhash64("word"))).alias("query_id"), F.concat(F.lit("zzqx"), F.col("word")).alias("query"))), _vocab(spark, sf))


FEATURES = f"""{VOCAB},
line as (select query_id, regexp_extract_all(lower(query), '[a-z0-9'']+') as w, lower(query) as t from queries),
content as (select *, list_filter(w, lambda x: not list_contains({STOP_WORDS}, x) and not list_contains({QUESTION_WORDS}, x)) as c from line),
known as (select query_id, count(*) as known from (select query_id, unnest(c) as term from content) join vocab using (term) group by query_id),
features as (select query_id, len(w) as words, len(c) as content_words, len(c) - coalesce(known, 0) as unknown_words,
  len(list_filter(w[1:2], lambda x: list_contains({QUESTION_WORDS}, x))) > 0 or ends_with(trim(t), '?') as question,
  case when len(w) > 0 then round(1 - len(c) / len(w)::double, 2) end as stopword_ratio, len(regexp_split_to_array(t, ',|;| and | or | but ')) as clauses
  from content left join known using (query_id))"""


def _features(spark, sf) -> DataFrame:
    parsed = text_queries(spark, sf).select("query_id", F.col("query").alias("words"), F.lit(None).cast("string").alias("phrase"), F.lit(False).alias("has_filters"))
    return N.route_features(parsed, _vocab(spark, sf), N.match_filenames(text_queries(spark, sf), file_records(spark, sf)))


@_register("route_features", f"with {FEATURES} select query_id, words::bigint as words, content_words::bigint as content_words, unknown_words::bigint as unknown_words, question, stopword_ratio, clauses::bigint as clauses from features")
def route_features(spark, sf):
    return _features(spark, sf).drop("exact", "has_filters", "filename_coverage")


@_register("route_tier", f"""with {FEATURES} select query_id, case when words = 0 then 'keyword' when words <= 3 and not question and unknown_words = 0 and content_words >= 1 then 'keyword' else 'hybrid' end as tier,
  (case when words = 0 then 0 when words <= 3 and not question and unknown_words = 0 and content_words >= 1 then 1 when content_words >= 7 or clauses >= 2 or (question and content_words >= 5) then 3 else 2 end)::bigint as complexity from features""")
def route_tier(spark, sf):
    return N.route(_features(spark, sf))


@_register("router_stats", """with usage_r as (select *, case when value < 20 then 'keyword' when value < 50 then 'filename' else 'hybrid' end as route from (select * from events order by ts desc, event_id desc limit 500))
select route, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share, round(avg(value), 1) as mean_ms, sum(case when event_type <> 'error' then 1 else 0 end)::bigint as with_results from usage_r group by route""")
def router_stats(spark, sf):
    from pyspark.sql import Window

    recent = read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    tier = F.when(F.col("value") < 20, "keyword").when(F.col("value") < 50, "filename").otherwise("hybrid").alias("route")
    by = recent.groupBy(tier).agg(F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean_ms"), F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("with_results"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


# -- ranking ------------------------------------------------------------------------------------------------------

SEM = """
semantic as (
  select query_id, chunk_id, doc_id, distance, row_number() over (partition by query_id order by distance, chunk_id) as rank from (
    select q.query_id, (v.vec_id // 4) || '#' || (v.vec_id % 4) as chunk_id, v.vec_id // 4 as doc_id,
      round(list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as distance
    from queries q join embeddings e on e.vec_id = q.query_id, embeddings v) where distance <= 1.6 qualify rank <= 20)"""
FUSED = f"""{BM25}, keyword as ({RANKED.format("greatest(1, ceil(n_terms / 2.0))")}), {SEM},
hits as (select coalesce(k.query_id, s.query_id) as query_id, coalesce(k.chunk_id, s.chunk_id) as chunk_id, coalesce(k.doc_id, s.doc_id) as doc_id, k.score as keyword_score, k.rank as keyword_rank, s.distance, s.rank as semantic_rank,
  round(coalesce(1.0::double / (60 + k.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0), 9) as fused from keyword k full outer join semantic s on k.query_id = s.query_id and k.chunk_id = s.chunk_id and k.doc_id = s.doc_id)"""
FILES = f"""{FUSED},
placed as (select *, row_number() over (partition by query_id, doc_id order by fused desc, keyword_rank nulls last, semantic_rank nulls last, chunk_id) as n from hits),
files as (select query_id, doc_id, round(max(fused) + 0.01::double * sum(case when n in (2, 3) then fused else 0 end), 9) as score, max(case when n = 1 then chunk_id end) as chunk_id, max(keyword_score) as keyword_score, min(distance) as distance from placed group by query_id, doc_id)"""
TIERED = f"""{FILES},
ctx as (select *, keyword_score is not null as lit, bool_or(keyword_score is not null) over (partition by query_id) as any_lit, min(case when keyword_score is null then distance end) over (partition by query_id) as best from files),
lim as (select *, case when any_lit then 1.45 else 1.5 end as lim from ctx),
tiered as (select *, case when lit or coalesce(distance <= lim, false) or coalesce(best <= lim and distance <= best + 0.08::double, false) then 'strong' else 'weak' end as confidence from lim)"""
PRUNED = f"""{TIERED},
near_ as (select *, bool_or(confidence = 'strong') over (partition by query_id) as any_strong, min(case when confidence = 'strong' then distance end) over (partition by query_id) as best_strong from tiered),
stay as (select *, row_number() over (partition by query_id, confidence order by score desc, doc_id) as m from near_ where confidence = 'strong' or not any_strong or coalesce(distance <= best_strong + 0.15::double, false)),
pruned as (select query_id, doc_id, chunk_id, score, confidence, row_number() over (partition by query_id order by case when confidence = 'strong' then 0 else 1 end, score desc, doc_id) as rank from stay where confidence = 'strong' or m <= 3)"""


def _semantic(spark, sf) -> DataFrame:
    v = read(spark, sf, "embeddings")
    asked = text_queries(spark, sf).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id").select("query_id", "query_vec")
    doc = F.floor(F.col("vec_id") / 4)
    named = v.select(F.concat_ws("#", doc.cast("string"), (F.col("vec_id") % 4).cast("string")).alias("chunk_id"), "embedding")
    hits = R.knn(asked, named, k=20, cutoff=1.6, key="chunk_id")
    return hits.withColumn("doc_id", F.substring_index("chunk_id", "#", 1).cast("long")).select("query_id", "chunk_id", "doc_id", "distance", "rank")


def _fused(spark, sf) -> DataFrame:
    return K.rrf(R.bm25_relaxed(text_queries(spark, sf), index(spark, sf)), _semantic(spark, sf))


@_register("rrf_fusion", f"with {FUSED} select query_id, chunk_id, fused from hits")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "chunk_id", "fused")


@_register("rerank_promotion", f"""with {FUSED}, p as (select *, row_number() over (partition by query_id order by fused desc, keyword_rank nulls last, semantic_rank nulls last, chunk_id) as place from hits)
select query_id, chunk_id, case when place <= 10 and doc_id % 7 - 3 > 0 then round(1 + (doc_id % 7 - 3) / 1000.0::double, 9) end as promoted from p""")
def rerank_promotion(spark, sf):
    hits = _fused(spark, sf)
    return K.promote(hits, hits.select("query_id", "chunk_id", (F.col("doc_id") % 7 - 3).cast("double").alias("logit"))).select("query_id", "chunk_id", "promoted")


@_register("file_aggregation", f"with {FILES} select query_id, doc_id, score, chunk_id from files")
def file_aggregation(spark, sf):
    return K.to_files(_fused(spark, sf)).select("query_id", "doc_id", "score", "chunk_id")


@_register("confidence_tier", f"with {TIERED} select query_id, doc_id, confidence from tiered")
def confidence_tier(spark, sf):
    return K.confidence(K.to_files(_fused(spark, sf))).select("query_id", "doc_id", "confidence")


@_register("weak_prune", f"with {PRUNED} select query_id, doc_id, confidence, rank::bigint as rank from pruned")
def weak_prune(spark, sf):
    return K.prune(K.confidence(K.to_files(_fused(spark, sf)))).select("query_id", "doc_id", "confidence", "rank")


@_register("hybrid_search", f"with {PRUNED}, {RECORDS} select query_id, p.doc_id, path, chunk_id, score, confidence, p.rank::bigint as rank from pruned p join records r on r.doc_id = p.doc_id where not deleted and rank <= 10")
def hybrid_search(spark, sf):
    """Keywords and meaning, fused, per file, tiered and pruned; tombstoned files are left out."""
    done = K.prune(K.confidence(K.to_files(_fused(spark, sf)))).where("rank <= 10")
    return done.join(file_records(spark, sf).where("not deleted").select("doc_id", "path"), "doc_id").select("query_id", "doc_id", "path", "chunk_id", "score", "confidence", "rank")


@_register("near_tie_rerank")
def near_tie_rerank(spark, sf):
    files = K.prune(K.confidence(K.to_files(_fused(spark, sf))))
    tokens = F.array_distinct(F.filter(T.tokens("content"), lambda w: F.length(w) >= 3))
    full = files.join(index(spark, sf).chunks().select("chunk_id", "content"), "chunk_id", "left").select("query_id", "doc_id", "rank", F.col("confidence").alias("band"), "score", (F.col("doc_id") % 11 / 10).alias("boost"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    return K.near_ties(full)


@_register("match_explanation", f"""with {PRUNED}, asked as (select query_id, list_sort(list_distinct({tokens_sql('query')})) as q from queries)
select p.query_id, p.doc_id, list_aggregate(list_filter([case when f.keyword_score is not null then 'Contains: ' || array_to_string(list_filter(q, lambda w: list_contains({tokens_sql('content')}, w)), ', ') else 'Meaning matches' end, 'Page ' || page_number], lambda x: x is not null), 'string_agg', ' | ') as why
from pruned p join files f using (query_id, doc_id) join asked a on a.query_id = p.query_id left join chunks c on c.chunk_id = p.chunk_id""")
def match_explanation(spark, sf):
    files = K.prune(K.confidence(K.to_files(_fused(spark, sf))))
    asked = text_queries(spark, sf).select("query_id", F.array_sort(F.array_distinct(T.tokens("query"))).alias("q"))
    held = files.join(asked, "query_id").join(index(spark, sf).chunks().select("chunk_id", "page_number", "content"), "chunk_id", "left")
    told = held.withColumns({"path": F.lit("x.txt"), "matched": F.array_intersect("q", T.tokens("content"))})
    return K.explain(told).select("query_id", "doc_id", F.array_join("why", " | ").alias("why"))


@_register("eval_metrics", """with pairs as (
  select q.vec_id as query_id, q.label = v.label as relevant, row_number() over (partition by q.vec_id order by round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6), v.vec_id) as rank
  from embeddings v, (select * from embeddings where vec_id % 50 = 0) q where v.vec_id <> q.vec_id),
sized as (select *, sum(case when relevant then 1 else 0 end) over (partition by query_id) as n_relevant from pairs),
by_q as (select query_id, n_relevant, sum(case when relevant and rank <= 5 then 1 else 0 end) as in_5, min(case when relevant then rank end) as first, sum(case when relevant and rank <= 5 then 1 / log2(rank + 1) else 0 end) as dcg from sized group by all)
select count(*)::bigint as queries, round(avg(in_5 / least(n_relevant, 5)::double), 6) as recall_5, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr,
  round(avg(dcg / list_sum(list_transform(range(1, least(n_relevant, 5)::bigint + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg_5 from by_q""")
def eval_metrics(spark, sf):
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("own"))
    return K.retrieval_metrics(R.judged(asked, v.select("vec_id", "embedding", "label", F.lit(True).alias("may"))))


@_register("jaccard_near_dupes", f"""with {BM25}, hits as ({RANKED.format("greatest(1, ceil(n_terms / 2.0))")}),
sets as (select chunk_id, list_distinct(list_filter({tokens_sql('content')}, lambda w: length(w) >= 3)) as s from chunks where chunk_id in (select chunk_id from hits))
select x.query_id, x.chunk_id as a, y.chunk_id as b, round(len(list_intersect(p.s, q.s)) / len(list_distinct(list_concat(p.s, q.s)))::double, 6) as jaccard
from hits x join hits y on x.query_id = y.query_id and x.chunk_id < y.chunk_id join sets p on p.chunk_id = x.chunk_id join sets q on q.chunk_id = y.chunk_id
where len(list_intersect(p.s, q.s)) / len(list_distinct(list_concat(p.s, q.s)))::double >= 0.5""")
def jaccard_near_dupes(spark, sf):
    """Pairs among each query's twenty best passages that share half of their words: what near-duplicate results are
    told by. Lists are bounded, so their pairs are."""
    hits = R.bm25_relaxed(text_queries(spark, sf), index(spark, sf)).select("query_id", "chunk_id")
    words = F.array_distinct(F.filter(T.tokens("content"), lambda w: F.length(w) >= 3)).alias("s")
    sets = hits.join(index(spark, sf).chunks().select("chunk_id", "content"), "chunk_id").select("query_id", "chunk_id", words)  # only of hits
    both = sets.selectExpr("query_id", "chunk_id as a", "s as sa").join(sets.selectExpr("query_id", "chunk_id as b", "s as sb"), "query_id").where("a < b")
    return both.withColumn("value", T.jaccard("sa", "sb")).where("value >= 0.5").select("query_id", "a", "b", F.round("value", 6).alias("jaccard"))
