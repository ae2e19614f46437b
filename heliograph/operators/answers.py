"""What an answer to a question rests on: numbered sources, citations, premises, and how it is worded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.text import canonical_name, filename

# Fixed values.
SOURCE_CHARS, LEAST_GAIN = 1600, 2
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
COMMON = "the this that with from your have will were been there their which about into also than then when what where they them files file found could couldn sources source".split()

# Fixed value: words that need another one after them.
_DANGLING = r"(?i)\b(?:is|was|are|were|the|a|an|of|on|at|in|to|for|by|from)[\s.!?]*$"

_MARKED = r"[a-z0-9][a-z0-9,.-]*[a-z0-9]|[a-z0-9]"
_NOTHING = (
    r"(?i)\b(?:no|not any|none of the)\b[^.!?]{0,60}\b(?:mention|information|answer|source|file|document|record|detail)s?\b"
    r"|\b(?:do|does|did|is|are|was|were|can|could)(?: not|n['’]t)\b[^.!?]{0,40}\b(?:mention|contain|say|state|specif|provide|include|determin|answer|found|find|know)\w*"
    r"|\bcan ?not be (?:determined|answered|found)\b|\bunable to (?:find|answer|determine)\b"
)
_REFERS = r"(?i)\b(?:it|its|that|this|those|these|they|them|their|he|she|his|her|him|there|then|same|other|another|one|ones|former|latter|above|previous|instead|again|else|too|also)\b|^(?:and|but|or|so|what about|how about)\b"


def distinctive(text: Column) -> Column:
    """Words that tell texts apart: four letters or more and not common ones, and whatever holds a digit."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_MARKED), F.lit(0)), lambda w: F.trim(w, F.lit(".,")))
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 4) & ~w.isin(*COMMON)) | w.rlike(r"\d")))


def weight(word: Column) -> Column:
    return F.when(word.rlike(r"\d"), 2).otherwise(1)


def numbered(found: DataFrame) -> DataFrame:
    """question_id, number, file_id, text: sources of a question, numbered as their files first turn up in its searches
    (turn, rank); further passages (text) of a file are added to its text, new ones only, cut at 1,600 characters."""
    by_file = found.groupBy("question_id", "file_id").agg(F.min(F.struct("turn", "rank")).alias("first"), F.sort_array(F.collect_list(F.struct("turn", "rank", "text"))).alias("all"))

    def add(so_far: Column, s: Column) -> Column:
        more = F.when(so_far == "", s["text"]).otherwise(F.substring(F.concat(so_far, F.lit("\n…\n"), s["text"]), 1, SOURCE_CHARS))
        return F.when((F.coalesce(s["text"], F.lit("")) == "") | F.contains(so_far, s["text"]), so_far).otherwise(more)

    line = Window.partitionBy("question_id").orderBy("first", "file_id")
    return by_file.select("question_id", F.row_number().over(line).cast("long").alias("number"), "file_id", F.aggregate("all", F.lit(""), add).alias("text"))


def trimmed_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id and cited: of an answer's citations (answer, cited) those whose sources (number, text) add something.
    The source with most of the answer's words stands; a further one, in the order of their weights, if what it adds to
    the words of those before weighs two or more. The answer's own order is kept; one citation alone stands."""
    one = answers.select("question_id", "cited", distinctive(F.col("answer")).alias("words"), F.posexplode("cited").alias("place", "number"))
    held = one.join(sources.select("question_id", "number", F.lower("text").alias("text")), ["question_id", "number"], "left")
    own = F.filter("words", lambda w: F.coalesce(F.contains(F.col("text"), w), F.lit(False)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, w: s + weight(w))
    scored = held.withColumn("own", own).groupBy("question_id", "cited").agg(F.sort_array(F.collect_list(F.struct((-total(F.col("own"))).alias("order"), "place", "number", "own"))).alias("ranked"))

    def keep(state: Column, s: Column) -> Column:
        gain = total(F.array_except(s["own"], state["covered"]))
        good = (F.size(state["kept"]) == 0) | (gain >= LEAST_GAIN)
        return F.when(good, F.struct(F.concat(state["kept"], F.array(s["number"])).alias("kept"), F.array_union(state["covered"], s["own"]).alias("covered"))).otherwise(state)

    kind = answers.schema["cited"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<string>").alias("covered"))
    kept = F.aggregate("ranked", start, keep)["kept"]
    return scored.select("question_id", F.filter("cited", lambda n: F.array_contains(kept, n)).alias("cited"))


def premise_problem(question: Column, sources: Column) -> Column:
    """What the question takes for granted and no source (their names and texts) mentions: a month, a weekday, a year, or
    the thing that it counts; null if there is none. A month may also stand as its number in a date."""
    text = F.lower(sources)
    words = F.transform(F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.regexp_replace(w, "'s$", ""))
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    brief = lambda w: F.contains(text, F.substr(w, F.lit(1), F.lit(3)))
    as_date = lambda w: F.regexp_like(text, F.concat(F.lit("[-/]0?"), number[w].cast("string"), F.lit("[-/]|\\b0?"), number[w].cast("string"), F.lit(r"[./]\d")))
    absent = lambda w: F.when(w.isin(*MONTHS), ~brief(w) & ~as_date(w)).when(w.isin(*WEEKDAYS), ~brief(w)).when(w.rlike(r"^(19|20)\d\d$"), ~F.contains(text, w)).otherwise(False)
    missing = F.element_at(F.filter(words, absent), 1)
    counted = F.regexp_extract(F.lower(question), r"\bhow many (?:of )?(?:the |my |our |all |different )*([a-z]+)", 1)
    lone = (counted != "") & ~F.regexp_like(text, F.concat(F.lit(r"\b"), F.regexp_replace(counted, "s$", "")))
    first = F.when(F.size(F.filter(words, absent)) > 0, F.concat(F.lit("the sources never mention "), missing))
    return F.coalesce(first, F.when(lone, F.concat(F.lit("the question counts “"), counted, F.lit("” but no source mentions it"))))


def says_nothing(answer: Column) -> Column:
    """Whether the first sentence says that the sources hold no answer."""
    return F.element_at(F.split(F.trim(answer), r"(?<=[.!?])\s", 2), 1).rlike(_NOTHING)


def breaks_off(answer: Column) -> Column:
    """Whether the last word needs another one."""
    return F.trim(answer).rlike(_DANGLING)


def refers_back(question: Column) -> Column:
    """Whether a question has a word that stands for something said before."""
    return F.trim(question).rlike(_REFERS)


def count_note(question: Column) -> Column:
    """The note for a count that the index didn't answer: its number is what a file says."""
    asked = F.lower(question).rlike(r"\b(?:how many|(?:number|count) of)\s+(?:(?:the|my|our|of|all|total|different)\s+)*(?:files?|items?|documents?|notes?|photos?|pictures?|images?|videos?|emails?|pdfs?|presentations?|spreadsheets?|recordings?|songs?)\b")
    return F.when(asked, "This number is what a file says, not a count of your files.")


def names_with_all(asked: DataFrame, records: DataFrame) -> DataFrame:
    """name and path of live files whose name holds every word asked for, one of three letters or more; however names
    join their words. The longest word is looked up among the names' pieces of as many letters, the others are tested."""
    words = F.split(F.regexp_replace(canonical_name("name"), r"\.[a-z0-9]{1,5}$", ""), " ")
    longest = F.element_at(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, F.length))), 1)
    q = asked.select("name", words.alias("w"), longest.alias("word")).where(F.length("word") >= 3).withColumn("n", F.length("word"))
    sizes = q.select("n").distinct()
    files = records.where("not deleted").select("path", canonical_name(filename("path")).alias("file"))
    pieces = files.join(sizes, F.length("file") >= F.col("n"))  # a row for each length of a word that was asked for
    pieces = pieces.withColumn("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("file") - F.col("n") + 1), lambda i: F.substr(F.col("file"), i, F.col("n"))))))
    met = pieces.join(q, ["n", "word"])
    return met.where(F.forall("w", lambda w: F.contains(F.col("file"), w))).select("name", "path").distinct()
