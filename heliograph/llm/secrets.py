"""Secret scans: fixed patterns, and strings that zstandard can't shorten though primed with their surroundings."""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import column, table, text_bytes

#: Kinds, as listed; the last is the method's.
KINDS = ("assign", "access", "hex", "novel")
#: A candidate is reported if it adds at least this share of the bytes that random strings of its shape add.
#: Calibrated on random strings and on words of prose and identifiers of code: recall is 0.95 from 16 characters.
NOVELTY = 0.88
#: Random strings that a candidate is compared with; very long candidates are compared with one.
DRAWS, LONG = 4, 8192
#: Below this share in the first of two orders of the surroundings, the second isn't tried.
HOPELESS = 0.6
#: Bytes on either side of a candidate that prime the compressor.
AROUND = 1024
#: A sensitive word counts for candidates that begin within so many bytes after it.
NEAR = 64

#: What code and configuration are full of; part of what the compressor knows beforehand.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key private_key public_key credential credentials authorization
authentication authenticate bearer username user_name account session cookie header certificate signature config
configuration environment variable parameter argument default example placeholder undefined null none true false
return function class static public private protected import export require include const let var def self this
string integer boolean number float double array object list dict map http https localhost client server request
response connection database host port path file directory index value name type data content message result error
exception handler manager service factory controller module package version abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000 xxxxxxxxxxxx ************ changeme your_token_here
your_secret_here your_password_here your_api_key_here get set put post delete update create read write open close
"""
_KNOWN = (IDENTIFIERS + IDENTIFIERS.upper()).encode()

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # runs of [0-9a-f]+ that aren't too short: a run is either taken whole or not at all
_SENSITIVE = re.compile(rb"passw|passphrase|secret|token|credential|private.?key|bearer|authoriz|api.?key|access.?key|client.?key|signing.?key")
_MARKS = (b"passw", b"passphrase", b"secret", b"token", b"credential", b"key", b"bearer", b"authoriz")
#: Characters of the shortest candidate.
SHORTEST = 12
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
#: Strings without a digit are words and names more often than not: too few letters measure too coarsely to tell.
WORDLIKE = 16
_WORD = re.compile(rb"[^0-9]+")

OUT = "doc_id long, spans array<struct<start:long,kind:int,end:long,novelty:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("novelty", pa.float64())]))
_HEX_DIGITS = (string.digits + "abcdef", string.digits + "ABCDEF")
_CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits)


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)


def drawn(own: bytes, k: int) -> bytes:
    """A random string of the same shape: each letter or digit is drawn from its class, among hexadecimal digits if the
    whole string is one of these; other characters stay. The same for every run."""
    text = own.decode()
    limit = next((digits for digits in _HEX_DIGITS if set(text) <= set(digits)), None)
    classes = [[c for c in letters if limit is None or c in limit] for letters in _CLASSES]
    of = {c: letters for letters in classes for c in letters}
    rng = random.Random(k)
    return "".join(rng.choice(of[c]) if c in of else c for c in text).encode()


def novelty(data: bytes, start: int, end: int) -> float:
    """Compressed bytes that data[start:end] adds to what primes the compressor, as a share of those that random strings
    of the same shape add there: about 1 for a random string, less for words and identifiers.

    Primed with the identifiers in either case and with AROUND bytes on either side, without further copies of the candidate, in two
    orders: both measurements together are finer than whole bytes.
    """
    own = data[start:end]
    before, after = data[max(0, start - AROUND) : start] + b" ", data[end : end + AROUND] + b" "
    draws = [drawn(own, k) for k in range(DRAWS if len(own) < LONG else 1)]
    size = lambda text: len(_compressor().compress(text))
    added = expected = 0.0
    for around in (before + after, after + before):
        known = (_KNOWN + around).replace(own, b"")
        base = size(known)
        added += size(known + own) - base
        expected += sum(size(known + d) - base for d in draws) / len(draws)
        if added < HOPELESS * expected:
            break
    return added / max(expected, 1.0)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns, in the order of their kinds."""
    out = []
    lowered = data.lower()
    if any(word in lowered for word in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if len(m[1]) >= 12]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return out


def candidates(data: bytes, lowered: bytes) -> list[tuple[int, int]]:
    """Runs of key characters that begin shortly after a sensitive word, or what follows a sensitive word within a run.

    One pass over runs and one over words: a run looks up the last word that ends before it, or the first inside it.
    """
    words = [(m.start(), m.end()) for m in _SENSITIVE.finditer(lowered)]
    begins, ends = [w[0] for w in words], [w[1] for w in words]
    out = []
    for m in _CANDIDATE.finditer(data) if words else ():
        start, end = m.span()
        last = bisect_right(ends, start) - 1
        if last < 0 or start - ends[last] > NEAR:
            inside = bisect_left(ends, start + 1)
            if inside == len(words) or begins[inside] >= end or end - ends[inside] < SHORTEST:
                continue
            start = ends[inside]
        if end - start >= WORDLIKE or not _WORD.fullmatch(data, start, end):
            out.append((start, end))
    return out


def novel_spans(data: bytes, taken: list[tuple[int, int, int]], least: float = NOVELTY) -> list[tuple[int, int, int, float]]:
    """Incompressible strings shortly after a sensitive word that no base span overlaps. Equal strings of a text are
    judged once, at the first."""
    lowered = data.lower()
    if not any(mark in lowered for mark in _MARKS):
        return []
    # spans of different kinds may overlap: for each start in order the furthest end so far
    starts, furthest = [], []
    for s, _, e in sorted(taken):
        starts.append(s)
        furthest.append(max(e, furthest[-1]) if furthest else e)
    out, judged = [], {}
    for start, end in candidates(data, lowered):
        before = bisect_left(starts, end) - 1
        if before >= 0 and furthest[before] > start:
            continue
        own = data[start:end]
        if own not in judged:
            judged[own] = novelty(data, start, end)
        if judged[own] >= least:
            out.append((start, 3, end, judged[own]))
    return out


def scan(text: bytes | None, least: float = NOVELTY) -> list[dict]:
    """All spans of a text in code points, by start, then kind."""
    data = text or b""
    base = base_spans(data)
    found = sorted([(*s, None) for s in base] + novel_spans(data, base, least), key=lambda s: s[:3])
    if found and not data.isascii():  # byte offsets to code points, each stretch decoded once
        points, at, n = {}, 0, 0
        for cut in sorted({x for s, _, e, _ in found for x in (s, e)}):
            n += len(data[at:cut].decode())
            points[cut], at = n, cut
        found = [(points[s], k, points[e], v) for s, k, e, v in found]
    return [dict(zip(("start", "kind", "end", "novelty"), s, strict=True)) for s in found]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([scan(t) for t in text_bytes(batch)], _SPANS)], ["doc_id", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start and end in code points, kind as in KINDS, novelty of the method's own) of every whole text.

    Takes doc_id and text; other columns are ignored. A null text is empty and has no span. Repeated rows and
    equal doc_ids each give a row. An empty table gives an empty result. A very long text is read once for each pattern;
    each different candidate costs up to twelve compressions of itself with the identifiers and the 1,024 bytes on either
    side, so time grows in proportion to the text and its candidates. No exchange.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_batches, OUT)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        count(3).alias("n_novel"),
    )
