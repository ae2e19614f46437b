"""File names against query words, spelling, and the router that picks the cheapest sufficient plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.config import NAME_GENERIC, NAME_NOISE, QUESTION_WORDS, STOP_WORDS, TYPE_GROUPS
from heliograph.functions.text import extension, filename, fold, name_tokens


def name_words(queries: DataFrame) -> DataFrame:
    """query_id, n_words, word: the words of a query that can name a file; generic ones only if there are no others."""
    words = F.filter(F.regexp_extract_all(fold("query"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*NAME_NOISE))
    typed = F.regexp_extract_all(F.lower("query"), F.lit(r"\.([a-z0-9]+)\b"), F.lit(1))
    specific = F.filter("all", lambda w: ~w.isin(*NAME_GENERIC) & ~F.array_contains(F.col("typed"), w))
    own = F.when(F.size("specific") > 0, F.concat("specific", F.filter("all", lambda w: F.array_contains(F.col("typed"), w)))).otherwise(F.col("all"))
    out = queries.select("query_id", words.alias("all"), typed.alias("typed")).withColumn("specific", specific)
    return out.select("query_id", own.alias("w")).select("query_id", F.size("w").alias("n_words"), F.posexplode("w").alias("place", "word"))


def match_filenames(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, doc_id, matched, n_words, coverage of files whose name holds at least half of a query's words, and two
    of them unless the query has only one.

    A name token fits a word if it is equal, if it begins with a word of four letters or more, or if it is one edit
    away from a word of six or more. Each is an equi-join on distinct words and tokens: on the word itself, on the
    token's beginnings, and on what is left of both when one letter is dropped. Audio files also match by their
    folder; the extension counts beside a matched word.
    """
    words = name_words(queries)
    distinct = words.select("word").distinct()
    audio = F.col("ext").isin(*TYPE_GROUPS["audio"]) | F.coalesce("audio_only", F.lit(False))
    folder = F.regexp_extract_all(fold(F.element_at(F.split("path", "/"), -2)), F.lit("[a-z0-9]+"), F.lit(0))
    tokens = records.where("not deleted").select("doc_id", F.explode(F.when(audio, F.concat(name_tokens("path"), folder)).otherwise(name_tokens("path"))).alias("token"))
    every = tokens.select("token").distinct()

    drops = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))
    equal = every.join(distinct, F.col("token") == F.col("word")).select("word", "token")
    begins = every.where(F.length("token") > 4).withColumn("word", F.explode(F.transform(F.sequence(F.lit(4), F.length("token") - 1), lambda n: F.substr(F.col("token"), F.lit(1), n)))).join(distinct, "word").select("word", "token")
    near = (
        every.where(F.length("token") >= 5).withColumn("key", F.explode(drops("token")))
        .join(distinct.where(F.length("word") >= 6).withColumn("key", F.explode(drops("word"))), "key")
        .where(F.levenshtein("word", "token", 1) >= 0)
        .select("word", "token")
    )
    pairs = equal.union(begins).union(near).distinct()
    hits = words.join(pairs, "word").join(tokens, "token").select("query_id", "n_words", "place", "doc_id", "word").distinct()
    met = hits.groupBy("query_id", "n_words", "doc_id").agg(F.count("*").alias("by_name"), F.collect_set("word").alias("found"))
    asked = words.groupBy("query_id").agg(F.collect_set("word").alias("asked"))
    ext = records.select("doc_id", "path", extension("path").alias("own_ext"))
    beside = (F.array_contains("asked", F.col("own_ext")) & ~F.array_contains("found", F.col("own_ext"))).cast("long")
    out = met.join(asked, "query_id").join(ext, "doc_id").withColumn("matched", F.col("by_name") + beside)
    good = (F.col("matched") * 2 >= F.col("n_words")) & ((F.col("matched") >= 2) | (F.col("n_words") == 1))
    return out.where(good).select("query_id", "doc_id", "path", "matched", F.col("n_words").cast("long").alias("n_words"), F.round(F.col("matched") / F.col("n_words"), 6).alias("coverage"))


def ranked_names(matches: DataFrame) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("matched"), F.lower(filename("path")), "doc_id")
    return matches.withColumn("rank", F.row_number().over(line).cast("long"))


def within_edits(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, term, occurrences, allowed: pairs among which are all that are one edit apart, two from seven letters on, and
    all in which one extends the other by at most two letters.

    With at most n edits one of n + 1 pieces of the word is still there, so candidates are met by pieces: every
    vocabulary word is joined on its substrings of a piece's length, if a word with such a piece is as long, two letters
    more or less. Edits before a piece move it by their number at most, so it has to stand near its place.
    """
    allowed = F.when(F.length("word") >= 7, 2).otherwise(1)
    cut = lambda i: F.bround(F.lit(i) * F.length("word") / (F.col("allowed") + 1)).cast("int")
    piece = lambda i: F.struct(cut(i).alias("at"), F.substr(F.col("word"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"))
    pieces = F.when(F.col("allowed") == 2, F.array(piece(0), piece(1), piece(2))).otherwise(F.array(piece(0), piece(1)))
    asked = words.select("word").distinct().withColumn("allowed", allowed).withColumn("p", F.explode(pieces)).select("word", "allowed", F.length("word").alias("size"), "p.at", "p.piece")
    lengths = asked.groupBy(F.length("piece").alias("n")).agg((F.min("size") - 2).alias("least"), (F.max("size") + 2).alias("most"))
    long = vocab.withColumn("len", F.length("term"))
    held = long.join(F.broadcast(lengths), (F.col("len") >= F.col("n")) & F.col("len").between(F.col("least"), F.col("most")))  # a row for each piece length
    held = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("n")))).withColumn("piece", F.substr(F.col("term"), F.col("i") + 1, F.col("n")))
    near = (F.abs(F.col("len") - F.col("size")) <= 2) & (F.abs(F.col("i") - F.col("at")) <= F.col("allowed"))
    return held.join(asked, "piece").where(near).select("word", "term", "occurrences", "allowed").distinct()


def closest_word(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word and correction: the best vocabulary word (term, occurrences) within one edit, or two from seven letters on;
    words that extend each other may be two apart. Extensions first, then distance, frequency, and the word.
    """
    pairs = within_edits(words, vocab)
    extends = F.col("term").startswith(F.col("word")) | F.col("word").startswith(F.col("term"))
    near = pairs.withColumn("extends", extends).withColumn("distance", F.levenshtein("word", "term", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.when(F.col("extends"), 2).otherwise(F.col("allowed"))))
    best = F.min(F.struct(~F.col("extends"), F.col("distance"), -F.col("occurrences"), F.col("term"))).alias("best")
    return near.groupBy("word").agg(best).select("word", F.col("best.term").alias("correction"), F.col("best.distance").cast("long").alias("distance"))


def swapped_word(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word and correction for words of four or five letters: two neighbours swapped give a known word, the most
    frequent, then the first swap."""
    swap = lambda i: F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.substr(F.col("word"), i + 1, F.lit(1)), F.substr(F.col("word"), i, F.lit(1)), F.substr(F.col("word"), i + 2))
    made = words.select("word").distinct().where(F.length("word").between(4, 5)).select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), swap)).alias("i", "term")).where("term <> word")
    return made.join(vocab, "term").groupBy("word").agg(F.max_by("term", F.struct(F.col("occurrences"), -F.col("i"))).alias("correction"))


# Fixed values.
COMMON, FAR_COMMONER = 500, 200


def checked_words(words: DataFrame, dictionary: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, correction and unknown of the words of a query for pictures, against a dictionary (term, occurrences) and a
    user's own words (term).

    A letter, a number, a word of the user's and a common word stay. The nearest word of the dictionary is a common one
    with two neighbours swapped (three letters or more), else one within an edit, two from seven letters on, with the
    same first or last letter: fewest edits, then the commonest; words of four and five letters only if they aren't
    listed at all. A listed but rare word is replaced if that one is two hundred times as common, an unlisted one in any
    case; without any it is unknown.
    """
    asked = words.select(F.lower("word").alias("word")).distinct()
    own = dictionary.select(F.col("term").alias("word"), F.col("occurrences").alias("listed"))
    open_ = asked.where((F.length("word") > 1) & ~F.col("word").rlike(r"^\d+$")).join(vocab.select(F.col("term").alias("word")), "word", "left_anti").join(own, "word", "left").where(F.col("listed").isNull() | (F.col("listed") < COMMON))
    swap = lambda i: F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.substr(F.col("word"), i + 1, F.lit(1)), F.substr(F.col("word"), i, F.lit(1)), F.substr(F.col("word"), i + 2))
    made = open_.where(F.length("word") >= 3).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), swap)).alias("term")).where("term <> word")
    swapped = made.join(dictionary.where(F.col("occurrences") >= COMMON), "term").select("word", "term", "occurrences", F.lit(0).alias("order"))
    long = open_.where((F.length("word") >= 6) | ((F.length("word") >= 4) & F.col("listed").isNull()))
    same_end = (F.substr("term", F.lit(1), F.lit(1)) == F.substr("word", F.lit(1), F.lit(1))) | (F.substr("term", F.lit(-1)) == F.substr("word", F.lit(-1)))
    met = within_edits(long, dictionary).where(same_end & (F.col("term") != F.col("word")) & (F.levenshtein("word", "term", 2).between(0, F.when(F.length("word") >= 7, 2).otherwise(1))))
    edited = met.select("word", "term", "occurrences", F.levenshtein("word", "term").alias("order"))
    best = F.min_by(F.struct("term", "occurrences"), F.struct("order", -F.col("occurrences"), F.col("term"))).alias("best")
    found = open_.join(swapped.unionByName(edited).groupBy("word").agg(best), "word", "left")
    good = F.col("best").isNotNull() & (F.col("listed").isNull() | (F.col("best.occurrences") >= FAR_COMMONER * F.col("listed")))
    told = found.select("word", F.when(good, F.col("best.term")).alias("correction"), (F.col("listed").isNull() & F.col("best").isNull()).alias("unknown"))
    return asked.join(told, "word", "left").select("word", "correction", F.coalesce("unknown", F.lit(False)).alias("unknown"))


def singulars(word: Column) -> Column:
    """What a plural may be the plural of."""
    cut = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    return F.filter(F.array(F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when(word.endswith("es"), cut(2)), F.when(word.endswith("s"), cut(1))), lambda x: x.isNotNull())


def plural_of_known(words: DataFrame, vocab: DataFrame) -> DataFrame:
    made = words.select("word").distinct().withColumn("term", F.explode(singulars(F.col("word"))))
    return made.join(vocab.select("term"), "term").select("word").distinct()


def correct_queries(queries: DataFrame, vocab: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """query_id and corrected: each unknown word replaced by its correction, separators kept.

    Known words, words with a digit and plurals of known words stay, and so do common words of a list (english: term,
    occurrences) if there is one; words under six letters are only corrected by a swap (four letters or more).
    """
    parts = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))).alias("i", "part")).withColumn("word", F.lower("part"))
    is_word = F.col("part").rlike(r"^\p{L}+$")
    known = vocab.select(F.col("term").alias("word"))
    open_ = parts.where(is_word).select("word").distinct().join(known, "word", "left_anti")
    open_ = open_.join(plural_of_known(open_, vocab), "word", "left_anti")
    if english is not None:
        open_ = open_.join(english.where(F.col("occurrences") >= COMMON).select(F.col("term").alias("word")), "word", "left_anti")
    fixed = closest_word(open_.where(F.length("word") >= 6), vocab).select("word", "correction").unionByName(swapped_word(open_, vocab))
    joined = parts.join(fixed, "word", "left").withColumn("out", F.coalesce("correction", "part"))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "out"))), lambda s: s["out"]), "").alias("corrected"))


def unrecognised(queries: DataFrame, vocab: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """query_id and whether none of the words means anything: not known, no plural of a known word, not correctable,
    no beginning (four letters or more) of a known one. A digit anywhere, or no word, recognises the query."""
    words = queries.select("query_id", F.col("query").rlike(r"\p{N}").alias("digit"), F.explode_outer(F.filter(F.regexp_extract_all(fold("query"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 2)).alias("word"))
    every = words.select("word").where("word is not null").distinct()
    if english is not None:  # words of a list mean something, too
        vocab = vocab.select("term", "occurrences").unionByName(english.select("term", "occurrences")).groupBy("term").agg(F.sum("occurrences").alias("occurrences"))
    heads = vocab.where(F.length("term") > 4).select(F.explode(F.transform(F.sequence(F.lit(4), F.length("term") - 1), lambda n: F.substr(F.col("term"), F.lit(1), n))).alias("word")).distinct()
    fine = (
        every.join(vocab.select(F.col("term").alias("word")), "word", "left_semi")
        .union(plural_of_known(every, vocab))
        .union(every.join(heads, "word", "left_semi"))
        .union(closest_word(every.where(F.length("word") >= 6), vocab).select("word"))
        .union(swapped_word(every, vocab).select("word"))
        .distinct()
        .withColumn("fine", F.lit(True))
    )
    return words.join(fine, "word", "left").groupBy("query_id").agg((~F.bool_or(F.coalesce("fine", F.lit(False)) | F.col("digit") | F.col("word").isNull())).alias("unrecognised"))


def route_features(parsed: DataFrame, vocab: DataFrame, names: DataFrame) -> DataFrame:
    """words, content_words, unknown_words, question, stopword_ratio, clauses and filename_coverage of each query."""
    text = F.lower("words")
    line = parsed.select("query_id", F.col("phrase").isNotNull().alias("exact"), "has_filters", F.regexp_extract_all(text, F.lit("[a-z0-9']+"), F.lit(0)).alias("w"), text.alias("t"))
    plain = F.filter("w", lambda x: ~x.isin(*STOP_WORDS) & ~x.isin(*QUESTION_WORDS))
    line = line.withColumn("content", plain)
    known = line.select("query_id", F.explode("content").alias("term")).join(vocab.select("term"), "term", "left_semi").groupBy("query_id").agg(F.count("*").alias("known"))
    covered = names.groupBy("query_id").agg(F.max("coverage").alias("filename_coverage"))
    out = line.join(known, "query_id", "left").join(covered, "query_id", "left")
    return out.select(
        "query_id",
        "exact",
        "has_filters",
        F.size("w").cast("long").alias("words"),
        F.size("content").cast("long").alias("content_words"),
        (F.size("content") - F.coalesce("known", F.lit(0))).cast("long").alias("unknown_words"),
        (F.exists(F.slice("w", 1, 2), lambda x: x.isin(*QUESTION_WORDS)) | F.trim("t").endswith("?")).alias("question"),
        F.when(F.size("w") > 0, F.round(1 - F.size("content") / F.size("w"), 2)).alias("stopword_ratio"),
        F.size(F.split("t", r",|;| and | or | but ")).cast("long").alias("clauses"),
        F.col("filename_coverage"),
    )


def route(features: DataFrame) -> DataFrame:
    """query_id, tier and complexity: the cheapest plan that should do."""
    c = F.col
    long_ = (c("content_words") >= 7) | (c("clauses") >= 2) | (c("question") & (c("content_words") >= 5))
    named = (c("words") >= 2) & (c("filename_coverage") >= 0.75)
    plain = (c("words") <= 3) & ~c("question") & (c("unknown_words") == 0) & (c("content_words") >= 1)
    tier = F.when(c("exact"), "keyword").when(c("words") == 0, F.when(c("has_filters"), "metadata").otherwise("keyword")).when(named, "filename").when(plain, "keyword").otherwise("hybrid")
    level = F.when(c("exact"), 1).when((c("words") == 0) | named, 0).when(plain, 1).when(long_, 3).otherwise(2)
    return features.select("query_id", tier.alias("tier"), level.cast("long").alias("complexity"))
