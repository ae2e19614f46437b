"""The query language: words, a whole-query phrase and key:value filters; and the filters on file records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.config import ARCHIVES, AUDIO, CODE, DOCUMENTS, IMAGES, OLD, SHEETS, SLIDES, TYPE_ALIASES, TYPE_GROUPS, VIDEOS, WEB
from heliograph.functions.text import human_size

FILTER = r"(?i)\b(type|ext|after|before|size|in):(\S+)"
UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _last(values: Column, keys: tuple[str, ...]) -> Column:
    """The value of the last token with one of the keys."""
    own = F.filter(values, lambda t: t["key"].isin(*keys))
    return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])


def parse_date(value: Column) -> Column:
    """2025, 2025-03 or 2025-03-14 as the beginning of that period, in seconds; null if it is none of these."""
    whole = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), value).when(value.rlike(r"^\d{4}-\d{1,2}$"), F.concat(value, F.lit("-01"))).when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01")))
    padded = F.regexp_replace(whole, r"-(\d)(?=-|$)", "-0$1")
    return F.unix_timestamp(F.try_to_timestamp(padded, F.lit("yyyy-MM-dd"))).cast("double")


def _size_bound(value: Column) -> Column:
    """struct(low, high): strict bounds in bytes; >= and <= move them by one byte."""
    part = lambda i: F.regexp_extract(value, r"(?i)^(>=|<=|>|<)?(\d+(?:\.\d+)?)(b|kb|mb|gb)?$", i)
    op, number, unit = part(1), part(2), F.lower(part(3))
    n = F.floor(F.try_to_number(number, F.lit("999999999999.999999")).cast("double") * F.coalesce(_map(UNITS)[unit], F.lit(1))).cast("long")
    n = F.when(op == ">=", n - 1).when(op == "<=", n + 1).otherwise(n)
    good = number != ""
    return F.struct(F.when(good & ~op.startswith("<"), n).alias("low"), F.when(good & op.startswith("<"), n).alias("high"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, words (without filters), phrase, file_type, after, before, size_min, size_max, path_contains.

    The last token of a key counts, but lower and upper size bounds each keep their last. A token with a bad value is
    taken out of the text and filters nothing. The phrase is set only if all that is left is one quoted string.
    """
    found = F.regexp_extract_all("query", F.lit(FILTER), F.lit(0))
    tokens = F.transform(found, lambda t: F.struct(F.lower(F.substring_index(t, ":", 1)).alias("key"), F.substr(t, F.instr(t, F.lit(":")) + 1).alias("value")))
    rest = F.trim(F.regexp_replace("query", FILTER, ""))
    bounds = F.transform(F.filter("tokens", lambda t: t["key"] == "size"), lambda t: _size_bound(t["value"]))
    last = lambda side: F.element_at(F.filter(F.transform("bounds", lambda b: b[side]), lambda x: x.isNotNull()), -1)
    kind = F.regexp_replace(F.lower(_last(F.col("tokens"), ("type", "ext"))), r"^\.+", "")
    out = queries.withColumn("tokens", tokens).withColumn("bounds", bounds).withColumn("rest", rest)
    quoted = F.col("rest").rlike(r'^"[^"]+"$')
    some = lambda side: F.when(F.exists("bounds", lambda b: b[side].isNotNull()), last(side))
    return out.select(
        "query_id",
        F.when(quoted, F.trim(F.regexp_replace("rest", '^"|"$', ""))).otherwise(F.col("rest")).alias("words"),
        F.when(quoted, F.regexp_replace("rest", '^"|"$', "")).alias("phrase"),
        F.coalesce(_map(TYPE_ALIASES)[kind], kind).alias("file_type"),
        parse_date(_last(F.col("tokens"), ("after",))).alias("after"),
        parse_date(_last(F.col("tokens"), ("before",))).alias("before"),
        some("low").alias("size_min"),
        some("high").alias("size_max"),
        F.trim(F.lower(_last(F.col("tokens"), ("in",))), F.lit("\"'")).alias("path_contains"),
    )


def in_type(file_type: Column, ext: Column, audio_only: Column) -> Column:
    """audio_only decides for audio and video; else the group's extensions, or the type as an extension."""
    groups = F.create_map(*[x for k, v in TYPE_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    by_ext = F.array_contains(F.coalesce(groups[file_type], F.array(file_type)), ext)
    return F.when(F.coalesce(audio_only, F.lit(False)) & file_type.isin("audio", "video"), file_type == "audio").otherwise(by_ext)


#: Queries that one pass over the records answers; more are answered in several.
BLOCK = 10_000


def matching(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """query_id and the records that its filters let through. The stated queries go to the records block by block, as
    ranges and substrings have no key to join on."""
    p, yes = F.col, F.lit(True)
    hold = (
        F.coalesce(in_type(p("file_type"), p("ext"), p("audio_only")), yes)
        & F.coalesce(p("modified_time") >= p("after"), yes)
        & F.coalesce(p("modified_time") < p("before"), yes)
        & F.coalesce(p("size") > p("size_min"), yes)
        & F.coalesce(p("size") < p("size_max"), yes)
        & F.coalesce(F.contains(F.lower(p("path")), p("path_contains")), yes)
    )
    live = records.where("not deleted")
    blocks = max(1, -(-parsed.count() // BLOCK))
    own = [parsed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else parsed for b in range(blocks)]
    return reduce(DataFrame.unionByName, [live.join(F.broadcast(some), hold) for some in own])


def contained(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Records under a watched root, or that are a watched file: an equi-join of a path and its parents with the roots
    (root). Roots are compared in lower case, without a slash at the end, as folders are the same however written."""
    parts = F.split(F.lower("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = roots.select(F.regexp_replace(F.lower("root"), "/+$", "").alias("_root")).distinct()
    inside = records.select("doc_id", F.explode(above).alias("_root")).join(own, "_root", "left_semi").select("doc_id").distinct()
    return records.join(inside, "doc_id", "left_semi")


def described(parsed: DataFrame) -> DataFrame:
    """query_id and told: each filter of a query in words, in a fixed order; an empty list without filters."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    bytes_ = lambda c: human_size(F.col(c))
    parts = F.array(
        F.concat(F.lit("type "), "file_type"),
        F.concat(F.lit("after "), day("after")),
        F.concat(F.lit("before "), day("before")),
        F.concat(F.lit("larger than "), bytes_("size_min")),
        F.concat(F.lit("smaller than "), bytes_("size_max")),
        F.concat(F.lit("in “"), "path_contains", F.lit("”")),
    )
    return parsed.select("query_id", F.array_compact(parts).alias("told"))


def newest(matches: DataFrame, k: int) -> DataFrame:
    """Filters without words: the newest k files of each query."""
    from pyspark.sql import Window

    line = Window.partitionBy("query_id").orderBy(F.desc("modified_time"), "doc_id")
    return matches.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= k)


def kind_of(ext: Column, audio_only: Column) -> Column:
    """Image before audio; a video without a picture is audio; of the text formats, code is what is no document."""
    document = [*DOCUMENTS, *SHEETS, *SLIDES, *WEB, *OLD, "rtf"]
    return (
        F.when(ext.isin(*IMAGES), "image")
        .when(F.coalesce(audio_only, F.lit(False)) | ext.isin(*AUDIO), "audio")
        .when(ext.isin(*VIDEOS), "video")
        .when(ext.isin(*document), "document")
        .when(ext.isin(*CODE), "code")
        .when(ext.isin(*ARCHIVES), "archive")
        .otherwise("other")
    )
