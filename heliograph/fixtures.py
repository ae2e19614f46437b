"""Tables of the engine's data model from the driver's tables, and the same as SQL for oracles."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS, EXTENSIONS, KINDS
from heliograph.operators.index import KeywordIndex
from heliograph.sources.tables import removed, shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_records(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    out = d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit("."), ext).alias("path"),
        F.col("n_chars").cast("long").alias("size"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double").alias("modified_time"),
        (F.col("doc_id") % 23 == 0).alias("deleted"),
        (F.col("doc_id") % 29 != 0).alias("indexed"),
        F.when(ext == "mp4", F.col("doc_id") % 3 == 0).alias("audio_only"),
        *([F.sha2("text", 256).alias("hash")] if hashed else []),
    )
    return out.withColumn("ext", F.regexp_extract("path", r"\.([^./]*)$", 1))


RECORDS = f"""
records as (
  select *, regexp_extract(path, '\\.([^./]*)$', 1) as ext from (
    select doc_id, doc_id::varchar as file_id,
      '/' || source || '/' || lang || '/doc_' || doc_id || '.' || list_extract({list(EXTENSIONS)}, (doc_id % 10 + 1)::int) as path,
      n_chars::bigint as size, (1704067200 + doc_id * 3600)::double as modified_time,
      doc_id % 23 = 0 as deleted, doc_id % 29 <> 0 as indexed,
      case when doc_id % 10 = 8 then doc_id % 3 = 0 end as audio_only, sha256(text) as hash
    from documents))"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id",
        "user_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.col("ts").cast("timestamp").alias("at"),
        kind.alias("kind"),
        k.alias("doc_id"),
        F.when(kind == "query", F.array(*(((k + 7 * i) % 100) for i in range(5)))).alias("results"),
    )


USAGE = """
usage as (
  select event_id, user_id, epoch_us(ts) / 1e6 as ts, ts as moment,
    case event_type when 'click' then 'file_opened' when 'purchase' then 'recommendation_clicked' when 'error' then 'file_revealed'
                    when 'view' then 'result_clicked' when 'signup' then 'query' end as kind,
    (props->>'$.k')::bigint as doc_id,
    case when event_type = 'signup' then [(props->>'$.k')::bigint % 100, ((props->>'$.k')::bigint + 7) % 100, ((props->>'$.k')::bigint + 14) % 100, ((props->>'$.k')::bigint + 21) % 100, ((props->>'$.k')::bigint + 28) % 100] end as results
  from events)"""


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2, 3 and 5 words of each benchmark item."""
    b = read(spark, sf_dir, "benchmark").withColumn("n", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))))
    words = F.split("text", r"\s+")
    return b.select((F.col("item_id") * 10 + F.col("n")).alias("query_id"), F.array_join(F.slice(words, 1, F.col("n")), " ").alias("query"))


QUERIES = r"""
queries as (
  select item_id * 10 + n as query_id, array_to_string(regexp_split_to_array(text, '\s+')[1:n], ' ') as query
  from benchmark, unnest([2, 3, 5]) as t(n))"""


def chunk_words(docs: DataFrame, size: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Windows of `size` words that share `overlap`; the last ends with the text. An overlap as large as the window
    is an error; a text without words has no chunk."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.size("words")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (n > 0) & ((s == 0) | (s + overlap < n)))
    return (
        docs.select("doc_id", words.alias("words"))
        .select("doc_id", "words", F.posexplode(starts).alias("chunk_index", "start"))
        .select(
            "doc_id",
            F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            F.col("chunk_index").cast("long").alias("chunk_index"),
            F.col("start").cast("long").alias("start_word"),
            F.least(F.col("start") + size, F.size("words")).cast("long").alias("end_word"),
            (F.col("chunk_index").cast("long") / 3).cast("long").alias("page") + F.lit(1),
            F.array_join(F.slice("words", F.col("start") + 1, size), " ").alias("content"),
        )
        .toDF("doc_id", "chunk_id", "chunk_index", "start_word", "end_word", "page_number", "content")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_words(read(spark, sf_dir, "documents").select("doc_id", "text"))


_INDEXES: dict[tuple[str, str], KeywordIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The index of the sample documents' chunks, built once for a session and a folder, as an engine's collection is."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        _INDEXES[key] = KeywordIndex.create(folder, chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "page_number", "content"))
        atexit.register(removed, spark, folder)
    return _INDEXES[key]


CHUNKS = r"""
split_words as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as words from documents),
chunks as (
  select doc_id, doc_id || '#' || i as chunk_id, i::bigint as chunk_index, (i * 80)::bigint as start_word, least(i * 80 + 100, len(words))::bigint as end_word,
    (i // 3 + 1)::bigint as page_number, array_to_string(words[i * 80 + 1 : i * 80 + 100], ' ') as content
  from (select doc_id, words, unnest(range(0, greatest(1, (len(words) + 79) // 80))) as i from split_words where len(words) > 0)
  where i = 0 or i * 80 + 20 < len(words))"""

FOLD = "strip_accents(lower({}))"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({FOLD.format(text)}, '[\\p{{L}}\\p{{N}}]+')"
