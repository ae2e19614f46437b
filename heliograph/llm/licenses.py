"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import column, table, text_bytes

#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, as words, and their labels.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "apache 2 0 license": "apache-2.0",
    "mit license": "mit",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "mozilla public license 2 0": "mpl-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
#: How much a licence asks for, by the beginning of its identifier; the first that fits counts.
OBLIGATIONS = (("agpl", 3), ("gpl", 3), ("lgpl", 2), ("mpl", 2), ("epl", 2), ("cddl", 2), ("cc-by-sa", 2), ("cc-by-nc", 3), ("cc-by-nd", 3), ("cc0", 0), ("unlicense", 0), ("0bsd", 0), ("apache", 1), ("mit", 1), ("bsd", 1), ("isc", 1), ("zlib", 1), ("bsl", 1), ("cc-by", 1), ("python", 1), ("psf", 1))
NAMES = ("none", "permissive", "weak", "strong", "unknown")
UNKNOWN = 4

#: Upper case to lower case, and every ASCII character that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAGGED = re.compile(r"spdx[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier[^\S\n]*:?[^\S\n]*([^\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[A-Za-z0-9.+:-]+|[()]")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}

OUT = "doc_id long, n_words long, hits array<struct<word:long,words:int,label:string,base:boolean>>, expressions array<struct<expression:string,licences:array<string>,obligation:string>>"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())]))),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("licences", pa.list_(pa.string())), ("obligation", pa.string())]))),
])


def tokens(line: str) -> list[str]:
    """The longest beginning of a line that is an expression, in one pass: operands and operators in turn, with every
    parenthesis closed."""
    out: list[str] = []
    depth, operand, at, whole = 0, True, 0, 0
    for m in _TOKEN.finditer(line):
        t = m[0]
        if line[at : m.start()].strip(" \t"):
            break
        if operand:
            if t == "(":
                depth += 1
            elif t == ")" or t.upper() in _BINDS:
                break
            else:
                operand = False
        elif t == ")" and depth:
            depth -= 1
        elif t.upper() in _BINDS:
            operand = True
        else:
            break
        out.append(t)
        at = m.end()
        if not operand and not depth:
            whole = len(out)
    return out[:whole]


def postfix(parts: list[str]) -> list[str] | None:
    """Shunting yard; None if the parts don't make an expression."""
    out: list[str] = []
    held: list[str] = []
    for t in parts:
        op = t.upper()
        if op in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[op]:
                out.append(held.pop())
            held.append(op)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            out.append(t)
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


def obligation(name: str) -> int:
    return next((level for start, level in OBLIGATIONS if name.lower().startswith(start)), UNKNOWN)


def evaluate(parts: list[str]) -> tuple[list[str], str] | None:
    """Licences that an expression names and what it asks for: `and` the most of both sides, `or` the least, as the
    reader may choose; `with` an exception one level less than a strong licence. None if it is no expression."""
    order = postfix(parts)
    if not order:
        return None
    stack: list[tuple[set[str], int]] = []
    for t in order:
        if t.upper() not in _BINDS:
            stack.append(({t.lower()}, obligation(t)))
            continue
        if len(stack) < 2:
            return None
        (b, y), (a, x) = stack.pop(), stack.pop()
        if t.upper() == "WITH":
            stack.append((a, 2 if x == 3 else x))
            continue
        few, many = sorted((a, b), key=len)
        many |= few  # the smaller into the larger, so that long chains cost no more than their length
        stack.append((many, max(x, y) if t.upper() == "AND" else min(x, y)))
    if len(stack) != 1:
        return None
    names, level = stack[0]
    return sorted(names), NAMES[level]


def expression(line: str) -> tuple[str, list[str], str] | None:
    """The longest valid expression at the beginning of a line: text, licences, obligation."""
    parts = tokens(line)
    found = evaluate(parts)
    return (" ".join(parts), *found) if found else None


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None) -> tuple[int, list[dict], list[dict]]:
    """Words of a text, hits (first word, length in words, label, whether of the contract), expressions."""
    words = (text or b"").translate(_FOLD).split()
    line = f" {b' '.join(words).decode()} "
    hits, tagged = [], False
    counted = spaces = 0
    for end, phrase in automaton().iter(line):  # in the order of ends
        spaces += line.count(" ", counted, end + 1)
        counted = end + 1
        if phrase == TAG:
            tagged = True
            continue
        n = phrase.count(" ") + 1
        word = spaces - n - 1
        for base, names in ((True, BASE), (False, NOTICES)):
            if phrase in names:
                hits.append({"word": word, "words": n, "label": names[phrase], "base": base})
    expressions = []
    if tagged:
        for m in _TAGGED.finditer(text.decode()):
            if found := expression(m[1]):
                expressions.append(dict(zip(("expression", "licences", "obligation"), found, strict=True)))
    return len(words), hits, expressions


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t) for t in text_bytes(batch)]
        columns = [column(batch, "doc_id"), *([f[i] for f in found] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, hits and expressions of every whole text.

    Takes doc_id and text; other columns are ignored. Words are runs of ASCII letters and digits and of all
    characters beyond ASCII, A-Z lower-cased. Overlapping phrases all count. A null or empty text has no word and
    no hit. Repeated rows and equal doc_ids each give a row. Of an expression that can't be parsed the longest beginning
    that can counts; a tag without an expression gives none. An empty table gives an empty result. A very long text is folded, split
    and scanned once, in time proportional to its length. No exchange: each text is scanned where it is read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_batches, OUT)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    label = lambda hits: F.transform(hits, lambda h: h["label"])
    joined = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    tagged = F.flatten(F.transform("expressions", lambda e: e["licences"]))
    starts = F.transform(base, lambda h: h["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(label(base)).alias("base_labels"),
        joined(F.concat(label("hits"), tagged)).alias("labels"),
        F.when(F.size("expressions") > 0, F.lit(1.0))
        .when(F.exists("hits", lambda h: ~h["base"]), F.lit(0.9))
        .when(F.size("hits") > 0, F.lit(0.6))
        .otherwise(F.lit(0.0))
        .alias("score"),
        F.array_join(F.transform("expressions", lambda e: F.concat(e["expression"], F.lit(" = "), e["obligation"])), "; ").alias("expressions"),
    )
