"""Listings as people see them: natural order, folders first, filters of a page, sizes and tabs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import NOW
from heliograph.functions.text import fold

DAY = 86400
#: Weak results that a list shows at most.
WEAK_LISTED = 5


def natural_key(name: Column | str) -> Column:
    """A name as it sorts: without case and accents, numbers by their value."""
    runs = F.regexp_extract_all(fold(name), F.lit(r"\d+|\D+"), F.lit(0))
    padded = lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 24, "0")).otherwise(r)
    return F.array_join(F.transform(runs, padded), "")


def listed(entries: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a folder's entries (name, is_dir): folders first, then by name; the name itself settles ties."""
    return entries.orderBy(F.desc("is_dir"), natural_key("name"), "name").offset(offset).limit(limit)


def counts(entries: DataFrame) -> DataFrame:
    """total, folders and files of a listing."""
    return entries.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("is_dir").cast("long")), F.lit(0)).alias("folders"), F.coalesce(F.sum((~F.col("is_dir")).cast("long")), F.lit(0)).alias("files"))


def filtered(entries: DataFrame, kind: str = "", when: str = "", name: str = "", indexed_only: bool = False, now: float = NOW) -> DataFrame:
    """entries (name, is_dir, kind, modified, indexed) that a page's filters leave. Kind and age don't touch folders;
    "other" is what is no medium and no document."""
    age = F.lit(now) - F.col("modified")
    of_kind = {"": F.lit(True), "other": F.col("kind").isin("other", "archive", "code")}.get(kind, F.col("kind") == kind)
    of_age = {"": F.lit(True), "today": age < DAY, "week": age < 7 * DAY, "month": age < 30 * DAY, "older": age >= 30 * DAY}[when]
    out = entries.where(F.col("is_dir") | (of_kind & of_age)).where(F.contains(F.lower("name"), F.lit(name.strip().lower())))
    return out.where("indexed") if indexed_only else out


#: Sizes as a page offers them, in the words of the query language.
SIZES = {"": "", "small": "size:<1mb", "medium": "size:>1mb size:<10mb", "large": "size:>10mb"}


def as_tokens(choices: DataFrame) -> DataFrame:
    """Adds tokens: the choices of a page (tab, type, after, before, size, folder) as filters of the query language. Of
    a folder's words the longest stands, as a filter is one word."""
    own = lambda key, value: F.when(value != "", F.concat(F.lit(f"{key}:"), value))
    kind = F.when(F.col("type") != "", F.col("type")).when(F.col("tab") != "all", F.col("tab"))
    size = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])[F.col("size")]
    words = F.split(F.trim("folder"), r"\s+")
    longest = F.element_at(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, F.length))), 1)
    parts = [own("type", kind), own("after", F.col("after")), own("before", F.col("before")), F.when(size != "", size), own("in", longest)]
    return choices.withColumn("tokens", F.array_join(F.array_compact(F.array(*parts)), " "))


def sorted_in_tier(results: DataFrame, by: str = "relevance", descending: bool = False) -> DataFrame:
    """results (query_id, rank, confidence, name, modified_time, size) in the order that a user asks for: never a weak
    one above a strong one, and at most five weak ones, the best by rank."""
    tier = F.when(F.col("confidence") == "strong", 0).otherwise(1)
    kept = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "confidence").orderBy("rank"))).where((tier == 0) | (F.col("_n") <= WEAK_LISTED)).drop("_n")
    key = {"relevance": F.col("rank"), "name": natural_key("name"), "modified": F.col("modified_time"), "size": F.col("size")}[by]
    key = key.desc() if descending and by != "relevance" else key.asc()
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(tier, key, "rank")).cast("long"))


def kept_filters(asked: DataFrame) -> DataFrame:
    """Adds kept and dropped: of a model's filters (filters) only those that the question gives a reason for: a type or
    folder that it names, a year that it mentions, a size that it speaks of."""
    tokens = F.regexp_extract_all("filters", F.lit(r"(?i)\b(?:type|ext|after|before|size|in):\S+"), F.lit(0))
    q = F.lower("question")
    year = q.rlike(r"\b(19|20)\d{2}\b")
    speaks = lambda *words: reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])

    def reason(token: Column) -> Column:
        key, value = F.lower(F.substring_index(token, ":", 1)), F.ltrim(F.lower(F.trim(F.substr(token, F.instr(token, F.lit(":")) + 1), F.lit("\"'"))), F.lit("."))
        named = F.array_contains(F.split(q, r"[^\p{L}\p{N}_]+"), value) | (value.isin("xlsx", "csv") & speaks("spreadsheet")) | ((value == "pptx") & speaks("slides", "presentation"))
        return F.when(key.isin("type", "ext"), named).when(key.isin("after", "before"), year & F.contains(q, F.substr(value, F.lit(1), F.lit(4)))).when(key == "in", F.contains(q, value)).otherwise(speaks("large", "small", "big", "mb", "kb", "gb", "size"))

    good = lambda t: F.coalesce(reason(t), F.lit(False))
    return asked.withColumn("_t", tokens).withColumns({"kept": F.array_join(F.filter("_t", good), " "), "dropped": F.array_join(F.filter("_t", lambda t: ~good(t)), ", ")}).drop("_t")


def ago(seconds: Column, moment: Column) -> Column:
    """How long ago something was: just now, minutes, hours, days up to sixty, then the day itself."""
    many = lambda n, unit: F.concat(F.format_number(n, 0), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    whole = lambda size: F.floor(seconds / size)
    day = F.concat(F.lit("on "), F.date_format(F.timestamp_seconds(moment), "d MMMM yyyy"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, many(whole(60), "minute")).when(seconds < DAY, many(whole(3600), "hour")).when(seconds < 60 * DAY, many(whole(DAY), "day")).otherwise(day)


# Fixed values.
PICTURE_WORDS = "photo photos photograph photographs picture pictures pic pics image images img imgs snap snaps snapshot snapshots shot shots video videos footage".split()
REQUEST_WORDS = "show find search look display give get me my all any some please pls".split()
ARTICLES = "a an the".split()
CONNECTORS = "of with showing from in on for to and or".split()


def picture_query(query: Column) -> Column:
    """What a query for pictures shows: without words for pictures and for asking, and without the connectors that this
    leaves at the ends. As it was if there was none of these or nothing is left."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.trim(w, F.lit(".,;:!?\"'()[]")))
    said = F.filter(words, lambda w: ~bare(w).isin(*PICTURE_WORDS, *REQUEST_WORDS))
    small = lambda w: bare(w).isin(*ARTICLES, *CONNECTORS)
    # at the start connectors go, and articles before them; at the end both go
    sign = F.array_join(F.transform(said, lambda w: F.when(bare(w).isin(*CONNECTORS), "c").when(bare(w).isin(*ARTICLES), "a").otherwise("w")), "")
    skip = F.length(F.regexp_extract(sign, "^((?:c|a(?=c))*)", 1))
    cut = F.length(F.regexp_extract(F.substr(sign, skip + 1), "([ac]*)$", 1))
    inner = F.slice(said, skip + 1, F.size(said) - skip - cut)
    left = F.exists(said, lambda w: ~small(w))
    return F.when((F.size(said) < F.size(words)) & left, F.array_join(inner, " ")).otherwise(F.trim(query))


def blank(pixels: Column) -> Column:
    """Whether a frame (luminances) shows nothing: 99 of 100 pixels under 16, none of 64."""
    ordered = F.array_sort(pixels)
    place = 0.99 * (F.size(ordered) - 1)
    at = lambda i: F.get(ordered, i.cast("int")).cast("double")
    p99 = at(F.floor(place)) + (place - F.floor(place)) * (at(F.ceil(place)) - at(F.floor(place)))
    return (F.size(pixels) > 0) & (p99 < 16) & (F.array_max(pixels) < 64)


def captured_at(original: Column, date: Column, modified: Column, now: float = NOW) -> Column:
    """When a photo was taken: its own date, its file's, or now."""
    read = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.date_format(F.coalesce(read(original), read(date), F.timestamp_seconds(modified), F.timestamp_seconds(F.lit(now))), "yyyy-MM-dd'T'HH:mm:ss")


def keyframes(frames: DataFrame, most: int = 120) -> DataFrame:
    """Of each file's frames (file_id, t) those a video is indexed by: every one, or every second, fourth ... so that
    fewer than twice as many as `most` are held, and of these at most that many, evenly."""
    line = Window.partitionBy("file_id")
    number = F.row_number().over(line.orderBy("t")) - 1
    own = frames.withColumn("_i", number).withColumn("_n", F.count("*").over(line))
    stride = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / (2 * most - 1)))).cast("long"))
    held = own.withColumn("_s", stride).where("_i % _s = 0").withColumns({"_j": F.col("_i") / F.col("_s"), "_m": F.ceil(F.col("_n") / F.col("_s"))})
    pick = F.floor(F.col("_j") * F.least(F.lit(most), F.col("_m")) / F.col("_m"))
    before = F.floor((F.col("_j") - 1) * F.least(F.lit(most), F.col("_m")) / F.col("_m"))
    return held.where((F.col("_j") == 0) | (pick > before)).drop("_i", "_n", "_s", "_j", "_m")

