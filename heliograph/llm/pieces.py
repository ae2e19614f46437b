"""SentencePiece encoding and decoding of BPE models by a table of prefixes.

BPE joins the neighbours with the best score first, leftmost on ties, whatever the scores. What it makes of a stretch doesn't depend on
what stands around it, as long as no join crosses its ends. Two things follow:

* A row of pieces is the encoding of its text exactly if each two neighbours are the encoding of theirs.
* So the encoding of a prefix is known by its last piece alone: of the pieces that end there exactly one is compatible
  with the last piece of the prefix before it.

An Aho-Corasick automaton finds all pieces that end at each place, longest first; the first that is compatible is kept.
From the last place the pieces are then read backwards. Characters without a piece become their bytes and never join.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import column, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of words, and pairs of pieces, that a worker remembers; which ones it does only changes how fast it is.
WORD_BYTES, WORD_CHARS, PAIRS = 96 << 20, 64, 1 << 19
#: A worker sends what it has once it holds so many ids, and holds no more of whole texts beyond the last one.
SLICE = 1 << 20
#: A text is cut into runs of letters, runs of other characters with any spaces before them, digits, tabs and line
#: breaks; a model of which any piece holds parts of two is refused.
_LETTER, _DIGIT, _BREAK = "A-Za-z\u00c0-\u024f", "0-9", "\\t\\n"
_CUT = re.compile(f" *(?:[{_LETTER}]+|[^ {_LETTER}{_DIGIT}{_BREAK}]+|[{_DIGIT}])?|[{_BREAK}]+")

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # the format's types of pieces


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A BPE model with byte fallback, without a normaliser's rules, user-defined or unused pieces; others are refused."""

    def __init__(self, data: bytes):
        self.unknown = " ⁇ "
        pieces, trainer, rules = [], {}, {}
        for n, value in _fields(data):
            if n == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(value))
            elif n == 3:
                rules = dict(_fields(value))
        if trainer.get(3) != 2 or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only BPE models that keep the text as it is and put a space before it")
        if any(kind in (USER, UNUSED) for *_, kind in pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.unknown = trainer[44].decode() if 44 in trainer else self.unknown
        self.score = {text: score for text, score, kind in pieces if kind == NORMAL}
        self.size = [len(text) for text, *_ in pieces]
        self.text = [text for text, *_ in pieces]
        bytes_ = {int(text[3:5], 16): k for k, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(bytes_) < 256 or {c for text in self.score for c in text} - self.score.keys():
            raise ValueError("only models with all bytes, and all characters of their pieces as pieces")
        if any(_CUT.fullmatch(text.replace(SPACE, " ")) is None for text in self.score):
            raise ValueError("only models whose pieces keep to spaces before letters only, or other signs only")
        self.bytes = [bytes_[b] for b in range(256)]
        self.byte = {k: b for b, k in bytes_.items()}
        #: What each id says, a byte as itself.
        self.said = [bytes([self.byte[k]]) if kind == BYTE else b"" if kind == CONTROL else self.unknown.encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode() for k, (text, _, kind) in enumerate(pieces)]
        self.controls = {k for k, (*_, kind) in enumerate(pieces) if kind == CONTROL}
        self.automaton = ahocorasick.Automaton()
        #: What stands at the left and at the right end of a piece while its joins are made, and the rank of the join
        #: that ends it; None if the joins don't come in order of their ranks.
        self.left: dict[int, list[tuple[str, float]] | None] = {}
        self.right: dict[int, list[tuple[str, float]] | None] = {}
        for k, (text, _, kind) in enumerate(pieces):
            if kind == NORMAL:
                joins: list[tuple[int, int, str]] = []
                if self.joined(text, joins) == [text]:  # a piece that no joins lead to is never used
                    self.automaton.add_word(text, k)
                    self.left[k], self.right[k] = self._ends(text, joins)
        self.automaton.make_automaton()
        self.words = _Words(self)
        self.pairs: dict[int, bool] = {}

    def joined(self, text: str, joins: list[tuple[int, int, str]] | None = None) -> list[str]:
        """BPE by its definition, for short strings: the best join first, the leftmost on ties. joins gets the place of
        each, how many parts follow, and what it makes."""
        parts, none = list(text), float("-inf")
        while len(parts) > 1:
            scores = [self.score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if joins is not None:
                joins.append((k, len(parts) - 1 - k, parts[k]))
        return parts

    def _ends(self, text: str, joins: list[tuple[int, int, str]]) -> tuple[list | None, list | None]:
        """The parts at the left end of a piece, with the rank of the join that ends each, and those at the right end."""
        ranks = [-self.score[made] for *_, made in joins]
        if any(x >= y for x, y in zip(ranks, ranks[1:], strict=False)):
            return None, None
        out = []
        for side, part in ((0, text[0]), (1, text[-1])):
            stages = []
            for join, rank in zip(joins, ranks, strict=True):
                if join[side] == 0:
                    stages.append((part, rank))
                    part = join[2]
            out.append([*stages, (part, float("inf"))])
        return out[0], out[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces are the encoding of their text: no join across their border comes before what ends
        either of its sides. Of joins with the same rank the left one comes first."""
        one, two = self.right[left], self.left[right]
        if one is None or two is None:
            a, b = self.text[left], self.text[right]
            return self.joined(a + b) == [a, b]
        i = j = 0
        none, score = float("-inf"), self.score
        while i < len(one) and j < len(two):
            (a, till), (b, until) = one[i], two[j]
            rank = -score.get(a + b, none)
            if rank < till and rank <= until:
                return False
            if till <= until:
                i += 1
            else:
                j += 1
        return True

    def table(self, text: str) -> list[int]:
        """The last piece of each prefix; -1 where it is a character without a piece."""
        last, size, pairs = [-1] * len(text), self.size, self.pairs
        for end, piece in self.automaton.iter(text):
            if last[end] < 0:
                at = end - size[piece]
                before = last[at] if at >= 0 else -1
                if before >= 0:
                    pair = before << 20 | piece
                    known = pairs.get(pair)
                    if known is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        known = pairs[pair] = self.compatible(before, piece)
                    if not known:
                        continue
                last[end] = piece
        return last

    def stretch(self, text: str) -> list[int]:
        """The ids of a text without its leading space, read backwards from the table."""
        last, out, at, size = self.table(text), [], len(text) - 1, self.size
        while at >= 0:
            piece = last[at]
            if piece < 0:
                out += [self.bytes[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                out.append(piece)
                at -= size[piece]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers. Pieces keep within what the pattern cuts, so each is encoded by itself."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, _CUT.findall(" " + text.replace(SPACE, " "))))

    def decode(self, ids: list[int]) -> str:
        """What the ids say; the space before the text is taken away. Bytes that are no character become U+FFFD each."""
        said = b"".join(map(self.said.__getitem__, ids))
        first = next((k for k in ids if self.said[k]), None)  # control pieces say nothing
        if first is not None and self.text[first][0] == SPACE:
            said = said[1:]
        if self.controls.isdisjoint(ids):
            try:
                return said.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_broken(ids, first)

    def _decode_broken(self, ids: list[int], first: int | None) -> str:
        """Character by character; bytes make up characters only where they stand together."""
        out, run = [], bytearray()
        for k in [*ids, None]:
            if k in self.byte:
                run.append(self.byte[k])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]
            if k is not None:
                out.append(self.said[k].decode())
        said = "".join(out)
        return said[1:] if first is not None and self.text[first][0] == SPACE else said


class _Words(dict):
    """Ids of words, with the spaces before them, as bytes; made when they are first asked for."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.held = pieces, 0

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.pieces.stretch(word.replace(" ", SPACE))).tobytes()
        if len(word) <= WORD_CHARS:
            size = getsizeof(word) + getsizeof(ids) + 64  # with its place in the table
            if self.held + size > WORD_BYTES:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = ids
        return ids


@lru_cache(2)
def model(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def default_model() -> str:
    return public_tokenizers.path(MODEL)


def _encoded(rows: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id and text, SLICE ids or one row at a time."""
    for batch in rows:
        keys, found, begin, size = column(batch, "doc_id"), [], 0, 0
        for at, text in enumerate(column(batch, "text"), 1):
            found.append(pieces.encode(text.as_py() or ""))
            size += len(found[-1]) // 4
            if size >= SLICE or at == len(keys):
                ends = pa.array(np.cumsum([0, *(len(f) // 4 for f in found)]), pa.int32())
                values = pa.Array.from_buffers(pa.int32(), size, [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays([keys[begin:at], pa.ListArray.from_arrays(ends, values)], ["doc_id", "ids"])
                found, begin, size = [], at, 0


def _decoded(rows: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ids with what the ids say, SLICE ids or one row at a time."""
    for batch in rows:
        keys, ids = column(batch, "doc_id"), column(batch, "ids")
        values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        for k in _under(ends, SLICE):
            said = [pieces.decode(values[a:b].tolist()) for a, b in zip(ends[k], ends[k.start + 1 : k.stop + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([keys[k], ids[k], pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])


def _under(ends: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with at most so many values each, a row at least."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, without begin or end ids.

    Takes doc_id and text; other columns are ignored. A null text is as an empty one, which has no ids. Repeated rows and
    equal or null doc_ids each give a row; an empty table gives an empty result. A very long text, also of a single
    word, takes time and memory in proportion to its length. No exchange: each text is encoded where it is read. path is
    a model's file on every machine.
    """
    path = path or default_model()
    return _texts(docs).mapInArrow(lambda rows: _encoded(rows, model(path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids with `decoded`, the text that the ids say.

    Control ids say nothing, an unknown one the model's mark for it; ids that the model doesn't have are an error. Null
    ids are as none and give an empty text. No exchange.
    """
    path = path or default_model()
    ids = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return ids.mapInArrow(lambda rows: _decoded(rows, model(path)), "doc_id long, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """decode(encode(docs)) by one worker a task, with one model, instead of two."""
    path = path or default_model()
    return _texts(docs).mapInArrow(lambda rows: _decoded(_encoded(rows, model(path)), model(path)), "doc_id long, ids array<int>, decoded string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_and_decode(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
