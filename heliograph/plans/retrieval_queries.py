"""Registered queries on text, chunks and access methods, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.config import FILLER
from heliograph.fixtures import CHUNKS, QUERIES, RECORDS, chunks, file_records, index, read, text_queries, tokens_sql
from heliograph.functions import text as T
from heliograph.operators import retrieval as R

Q: dict = {}
SQL: dict[str, str] = {}

DOCS = "documents"
# A text that needs each rule, from columns that both engines see alike.
MESSY = r"concat('  ', source, chr(13), chr(10), chr(10), chr(10), chr(10), lang, '   ', lang, chr(9), 'é', coalesce(text, ''), '  ')"
SLOPPY = "concat(lang, ' ', lang, ' ,', source, ';x  find 3.5 ', source, '  type:pdf ', regexp_replace(coalesce(text, ''), '[^a-z]+', ' '))"


def _register(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@_register("normalize_text", rf"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({MESSY}), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents""")
def normalize_text(spark, sf):
    return read(spark, sf, DOCS).select("doc_id", F.expr(MESSY).alias("t")).select("doc_id", T.normalize_text("t").alias("text"))


@_register("tidy_query", r"""
with w as (select doc_id, lang, source, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents)
select doc_id, trim(lang || ', ' || source || '; x find 3.5 ' || source || ' type:pdf ' || array_to_string(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), ' ')) as text from w""")
def tidy_query(spark, sf):
    return read(spark, sf, DOCS).select("doc_id", F.expr(SLOPPY).alias("t")).select("doc_id", T.tidy_query("t").alias("text"))


@_register("content_words", rf"""
select doc_id, len(words)::bigint as n_content, array_to_string(words, ' ') as words from (
  select doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+'), lambda w: trim(w, '''')), lambda w: length(w) > 1 and not list_contains({FILLER}, w)) as words from documents)""")
def content_words(spark, sf):
    found = read(spark, sf, DOCS).select("doc_id", T.content_words("text").alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_content"), F.array_join("w", " ").alias("words"))


@_register("name_tokens", f"with {RECORDS} select doc_id, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '')), '[a-z0-9]+'), ' ') as tokens from records")
def name_tokens(spark, sf):
    return file_records(spark, sf).select("doc_id", F.array_join(T.name_tokens("path"), " ").alias("tokens"))


def _phonetic_sql(text):
    s = f"regexp_replace(lower({text}), '[^a-z0-9]', '', 'g')"
    for a, b in (("ph", "f"), ("ck", "k"), ("sh", "x"), ("ch", "j"), ("th", "0"), ("wr", "r"), ("kn", "n"), ("gh", "")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"regexp_replace(regexp_replace({s}, 'g([eiy])', 'j\\1', 'g'), 'c([eiy])', 's\\1', 'g')"
    s = f"translate(replace(translate({s}, 'cq', 'kk'), 'x', 'ks'), 'bdgvz', 'ptkfs')"
    return s


# RE2 has no back-references: each sign's runs are squeezed by themselves
_SQUEEZE = "bare"
for _ch in "0123456789aeioubcdfgjklmnpqrstvxz":
    _SQUEEZE = f"regexp_replace({_SQUEEZE}, '{_ch}+', '{_ch}', 'g')"


@_register("phonetic_key", rf"""
with words as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
coded as (select word, {_phonetic_sql('word')} as s from words),
bare as (select word, regexp_extract(s, '^[aeiou]', 0) || regexp_replace(substr(s, length(regexp_extract(s, '^[aeiou]', 0)) + 1), '[aeiouyhw]', '', 'g') as bare from coded)
select word, {_SQUEEZE} as key from bare""")
def phonetic_key(spark, sf):
    words = read(spark, sf, DOCS).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.phonetic_key("word").alias("key"))


@_register("chunk_words", f"with {CHUNKS} select chunk_id, doc_id, chunk_index, start_word, end_word, page_number, content from chunks")
def chunk_words(spark, sf):
    return chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index", "start_word", "end_word", "page_number", "content")


@_register("chunk_coverage", f"with {CHUNKS} select doc_id, count(*)::bigint as n_chunks, max(end_word)::bigint as n_words, sum(end_word - start_word)::bigint as words_held from chunks group by doc_id")
def chunk_coverage(spark, sf):
    return chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("end_word").alias("n_words"), F.sum(F.col("end_word") - F.col("start_word")).alias("words_held"))


@_register("page_groups", f"""with {CHUNKS}, marked as (select *, case when lag(page_number) over (partition by doc_id order by chunk_index) is distinct from page_number then 1 else 0 end as fresh from chunks),
grouped as (select *, sum(fresh) over (partition by doc_id order by chunk_index) as grp from marked)
select doc_id, grp::bigint as page_group, min(chunk_index)::bigint as first_chunk, count(*)::bigint as n_chunks, min(page_number)::bigint as page_number from grouped group by doc_id, grp""")
def page_groups(spark, sf):
    line = Window.partitionBy("doc_id").orderBy("chunk_index")
    fresh = (~F.lag("page_number").over(line).eqNullSafe(F.col("page_number"))).cast("long")
    marked = chunks(spark, sf).withColumn("fresh", fresh).withColumn("page_group", F.sum("fresh").over(line))
    return marked.groupBy("doc_id", "page_group").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("n_chunks"), F.min("page_number").alias("page_number"))


@_register("block_offsets", f"with {CHUNKS} select chunk_id, (coalesce(sum(length(content) + 2) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), 0))::bigint as start_offset from chunks")
def block_offsets(spark, sf):
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks(spark, sf).select("chunk_id", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)).cast("long").alias("start_offset"))


@_register("vocabulary", f"with {CHUNKS} select term, count(*)::bigint as occurrences from (select unnest({tokens_sql('content')}) as term from chunks) where length(term) >= 3 group by term")
def vocabulary(spark, sf):
    return index(spark, sf).vocabulary()


@_register("vocabulary_with_names", f"""with {CHUNKS}, {RECORDS}, both_ as (
  select unnest({tokens_sql('content')}) as term from chunks union all
  select unnest(regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '')), '[a-z0-9]+')) from records)
select term, count(*)::bigint as occurrences from both_ where length(term) >= 3 group by term""")
def vocabulary_with_names(spark, sf):
    names = file_records(spark, sf).select(F.explode(T.name_tokens("path")).alias("term")).where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("occurrences"))
    return index(spark, sf).vocabulary().unionByName(names).groupBy("term").agg(F.sum("occurrences").alias("occurrences"))


BM25 = rf"""
{CHUNKS}, {QUERIES},
toks as (select chunk_id, doc_id, {tokens_sql('content')} as w from chunks),
stats as (select count(*) as n_chunks, avg(len(w)) as mean_len from toks),
terms as (select query_id, len(t) as n_terms, unnest(t) as term from (select query_id, list_distinct({tokens_sql('query')}) as t from queries) where len(t) > 0),
posts as (select term, chunk_id, doc_id, chunk_len, count(*) as tf from (select chunk_id, doc_id, len(w) as chunk_len, unnest(w) as term from toks) group by all),
wanted as (select * from posts where term in (select term from terms)),
df as (select term, count(*) as df from wanted group by term),
scored as (
  select query_id, n_terms, chunk_id, doc_id, count(*) as found,
    round(sum(ln(1 + (n_chunks - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * chunk_len / mean_len))), 6) as score
  from wanted join df using (term) join terms using (term), stats group by all)"""
RANKED = "select query_id, chunk_id, doc_id, score, rank::bigint as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored where found >= {}) where rank <= 20"


@_register("bm25_and", f"with {BM25} " + RANKED.format("n_terms"))
def bm25_and(spark, sf):
    return R.bm25_and(text_queries(spark, sf), index(spark, sf))


@_register("bm25_min_should_match", f"with {BM25} " + RANKED.format("greatest(1, ceil(n_terms / 2.0))"))
def bm25_min_should_match(spark, sf):
    return R.bm25_relaxed(text_queries(spark, sf), index(spark, sf))


@_register("phrase_match", rf"""with {CHUNKS}, {QUERIES},
terms as (select query_id, len(t) as n, unnest(t) as term, generate_subscripts(t, 1) as i from (select query_id, {tokens_sql('query')} as t from queries) where len(t) > 0),
places as (select chunk_id, unnest(w) as term, generate_subscripts(w, 1) as pos from (select chunk_id, {tokens_sql('content')} as w from chunks)),
runs as (select query_id, n, chunk_id, pos - i as start, count(*) as found from places join terms using (term) group by all)
select query_id, chunk_id, count(*)::bigint as places from runs where found = n group by all""")
def phrase_match(spark, sf):
    return R.phrase_match(text_queries(spark, sf), index(spark, sf)).select("query_id", "chunk_id", "places")


@_register("snippet_windows", rf"""with {BM25}, hits as ({RANKED.format("greatest(1, ceil(n_terms / 2.0))")}),
asked as (select query_id, list_distinct({tokens_sql('query')}) as q from queries),
held as (select query_id, chunk_id, q, regexp_split_to_array(content, ' ') as w from hits join asked using (query_id) join chunks using (chunk_id)),
pos as (select query_id, chunk_id, i, unnest(list_filter(q, lambda x: list_contains({tokens_sql('w[i]')}, x))) as word from (select *, unnest(range(1, len(w) + 1)) as i from held)),
latest as (select a.query_id, a.chunk_id, a.i as stop, b.word, max(b.i) as i from (select distinct query_id, chunk_id, i from pos) a join pos b on a.query_id = b.query_id and a.chunk_id = b.chunk_id and b.i <= a.i group by all),
ends as (select query_id, chunk_id, stop, min(i) as first, count(*) as n from latest group by all),
best as (select query_id, chunk_id, arg_min(first, (-n, stop - first, first)) as first from ends group by all),
cut as (select query_id, chunk_id, q, w, first, greatest(first - 5, 1) as start from held left join best using (query_id, chunk_id))
select query_id, chunk_id, case when first > 0 then (case when start > 1 then '...' else '' end) || array_to_string(list_transform(w[start : start + 19], lambda x: case when len(list_intersect({tokens_sql('x')}, q)) > 0 then '**' || x || '**' else x end), ' ') || (case when len(w) > start + 19 then '...' else '' end) end as snippet from cut""")
def snippet_windows(spark, sf):
    """Snippets of all queries' best passages, around the place where most of the words stand together."""
    asked = text_queries(spark, sf).select("query_id", F.array_distinct(T.tokens("query")).alias("words"))
    hits = R.bm25_relaxed(text_queries(spark, sf), index(spark, sf)).select("query_id", "chunk_id").join(asked, "query_id")
    return R.snippets(hits.join(index(spark, sf).chunks().select("chunk_id", "content"), "chunk_id")).select("query_id", "chunk_id", "snippet")


@_register("snippet_highlight", rf"""with {CHUNKS},
parts as (select chunk_id, regexp_split_to_array(content, ' ') as w from chunks),
found as (select chunk_id, w, list_position(list_transform(w, lambda x: list_contains({tokens_sql('x')}, 'the')), true) as first from parts),
cut as (select chunk_id, w, first, greatest(first - 5, 1) as start from found)
select chunk_id, case when first > 0 then (case when start > 1 then '...' else '' end) || array_to_string(list_transform(w[start : start + 19], lambda x: case when list_contains({tokens_sql('x')}, 'the') then '**' || x || '**' else x end), ' ') || (case when len(w) > start + 19 then '...' else '' end) end as snippet from cut""")
def snippet_highlight(spark, sf):
    return R.highlight(chunks(spark, sf).withColumn("word", F.lit("the"))).select("chunk_id", "snippet")


def _vectors(spark, sf):
    v = read(spark, sf, "embeddings")
    return v.select("vec_id", "embedding", "label"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


KNN = """
pairs as (
  select q.vec_id as query_id, v.vec_id, v.label, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as distance
  from embeddings v, (select * from embeddings where vec_id % 50 = 0) q)"""


@_register("knn_l2", f"with {KNN} select query_id, vec_id, distance, rank::bigint as rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs) where rank <= 20")
def knn_l2(spark, sf):
    v, q = _vectors(spark, sf)
    return R.knn(q, v.select("vec_id", "embedding"))


@_register("knn_filtered", f"with {KNN} select query_id, vec_id, distance, rank::bigint as rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs where label = 3) where rank <= 20")
def knn_filtered(spark, sf):
    v, q = _vectors(spark, sf)
    return R.knn(q, v.where("label = 3").select("vec_id", "embedding"))


@_register("relevance_cutoff", f"with {KNN} select query_id, vec_id, distance, rank::bigint as rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs where distance <= 1.6) where rank <= 20")
def relevance_cutoff(spark, sf):
    v, q = _vectors(spark, sf)
    return R.knn(q, v.select("vec_id", "embedding"), cutoff=1.6)


@_register("centroid_by_label", """with flat as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
means as (select label, i, avg(x) as x from flat group by all)
select label, i::bigint as i, case when n > 0 then round(x / n, 6) end as x from (select *, sqrt(sum(x * x) over (partition by label)) as n from means)""")
def centroid_by_label(spark, sf):
    return R.centroids(read(spark, sf, "embeddings"), "label")


@_register("passage_neighbours", f"with {CHUNKS} select chunk_id, lag(chunk_id) over w as previous, lead(chunk_id) over w as next, count(*) over (partition by doc_id)::bigint as total from chunks window w as (partition by doc_id order by chunk_index)")
def passage_neighbours(spark, sf):
    return R.passage_neighbours(chunks(spark, sf))


@_register("file_text", f"with {CHUNKS} select doc_id, substr(t, 1, 20000) as text, length(t) > 20000 as truncated from (select doc_id, string_agg(content, chr(10) || chr(10) order by chunk_index) as t from chunks group by doc_id)")
def file_text(spark, sf):
    return R.file_text(chunks(spark, sf))


@_register("first_chunk", f"with {CHUNKS} select doc_id, chunk_id, content from chunks where chunk_index = 0")
def first_chunk(spark, sf):
    return R.first_chunk(chunks(spark, sf))


@_register("read_more", f"with {CHUNKS} select doc_id, substr(string_agg(content, chr(10) order by chunk_index), 1, 1600) as text from chunks where chunk_index < 3 group by doc_id")
def read_more(spark, sf):
    return R.file_text(chunks(spark, sf).where("chunk_index < 3"), 1 << 30).select("doc_id", F.substring(F.replace("text", F.lit("\n\n"), F.lit("\n")), 1, 1600).alias("text"))
