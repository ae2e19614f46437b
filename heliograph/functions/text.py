"""Column functions on text: normalising, tokens, names, phonetic keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.config import ACCENTED, FILLER, PLAIN

WORD = r"[\p{L}\p{N}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """Lower case without accents: accented Latin letters become plain ones, combining marks go."""
    return F.translate(F.lower(_c(text)), ACCENTED, PLAIN)


def _normal_form(text: Column, form: str) -> Column:
    """Spark has no function for it, so an Arrow batch of texts at a time."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return F.pandas_udf(each, "string")(text)


def nfc(text: Column | str) -> Column:
    """Composed characters."""
    return _normal_form(_c(text), "NFC")


def nfd(text: Column | str) -> Column:
    """Decomposed characters."""
    return _normal_form(_c(text), "NFD")


def tokens(text: Column | str) -> Column:
    """Folded words: runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def token_line(text: Column | str) -> Column:
    """The tokens with a space between: one string to send to a task's Python, not a string for each word."""
    t = _c(text)
    folded = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(fold(t))  # ASCII has no accents
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def normalize_text(text: Column | str) -> Column:
    """Composed characters, one kind of line end, single spaces, at most one empty line, no white space at the ends."""
    lines = F.regexp_replace(nfc(text), r"\r\n?", "\n")
    squeezed = F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, r"^\s+|\s+$", "")


def tidy_query(text: Column | str) -> Column:
    """Doubled words once, spaces around punctuation put right; colons and decimals stay."""
    once = F.regexp_replace(_c(text), r"(?i)\b(\w+)(\s+\1\b)+", "$1")
    before = F.regexp_replace(once, r"\s+([,.;!?])", "$1")
    after = F.regexp_replace(before, r"([,;])([A-Za-z])", "$1 $2")
    return F.trim(F.regexp_replace(after, r"\s{2,}", " "))


def content_words(text: Column | str) -> Column:
    """Words that carry intent: no filler, more than one character."""
    found = F.transform(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), lambda w: F.trim(w, F.lit("'")))
    filler = F.array(*map(F.lit, FILLER))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(filler, w))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]*)$", 1))


def filename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(filename(path), r"\.[^.]*$", "")


def name_tokens(path: Column | str) -> Column:
    return F.regexp_extract_all(fold(stem(path)), F.lit("[a-z0-9]+"), F.lit(0))


def singular(word: Column | str) -> Column:
    w = _c(word)
    cut = lambda n: F.substr(w, F.lit(1), F.length(w) - n)
    return (
        F.when(w.rlike("ies$") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(zzes|sses|xes|ches|shes)$"), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )


def canonical_name(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(_c(text)), F.lit("\\"), F.lit("/")), r"[\s_\-]+", " "))


# Fixed values.
SOUNDS = (("ph", "f"), ("ck", "k"), ("sh", "x"), ("ch", "j"), ("th", "0"), ("wr", "r"), ("kn", "n"), ("gh", ""))
VOICED, UNVOICED = "bdgvz", "ptkfs"


def phonetic_key(text: Column | str) -> Column:
    """Consonants as they sound: digraphs joined, soft c and g, voiced as unvoiced, vowels dropped but a first one."""
    s = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")
    for sound, sign in SOUNDS:
        s = F.replace(s, F.lit(sound), F.lit(sign))
    s = F.regexp_replace(F.regexp_replace(s, "g(?=[eiy])", "j"), "c(?=[eiy])", "s")
    s = F.replace(F.translate(s, "cq", "kk"), F.lit("x"), F.lit("ks"))
    s = F.translate(s, VOICED, UNVOICED)
    lead = F.regexp_extract(s, "^[aeiou]", 0)
    return F.regexp_replace(F.concat(lead, F.regexp_replace(F.substr(s, F.length(lead) + 1), "[aeiouyhw]", "")), r"(.)\1+", "$1")


def spoken_key(text: str) -> str:
    """phonetic_key of a Python string, for code that compares keys in a task."""
    s = re.sub("[^a-z0-9]", "", text.lower())
    for sound, sign in SOUNDS:
        s = s.replace(sound, sign)
    s = re.sub("c(?=[eiy])", "s", re.sub("g(?=[eiy])", "j", s)).translate(str.maketrans("cq", "kk")).replace("x", "ks")
    s = s.translate(str.maketrans(VOICED, UNVOICED))
    return re.sub(r"(.)\1+", r"\1", s[:1] + re.sub("[aeiouyhw]", "", s[1:]) if s[:1] in tuple("aeiou") else re.sub("[aeiouyhw]", "", s))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of two sets' elements that both have; NaN, which is larger than any number, if neither has one."""
    every = F.size(F.array_union(_c(a), _c(b)))
    return F.when(every > 0, F.size(F.array_intersect(_c(a), _c(b))) / every).otherwise(F.lit(float("nan")))


def human_size(n: Column | str) -> Column:
    n = _c(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        x = n / size  # six significant digits without trailing zeros
        x = F.when(x < 10, F.bround(x, 5)).when(x < 100, F.bround(x, 4)).when(x < 1000, F.bround(x, 3)).otherwise(F.bround(x, 2))
        shown = F.regexp_replace(x.cast("string"), r"\.0$", "")
        out = F.when(n >= size, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out
