"""Suffix-array dedup: repeated byte windows across documents, by a depth-limited radix sort of anchored suffixes.

Sorting every suffix of a corpus to the depth of a window would ship more than ten times the corpus. Two things keep
it near the corpus' own size:

* Anchors. In every window of WINDOW bytes the DIGIT-byte string with the smallest hash is the window's anchor. Equal
  windows have equal anchors at equal places, so only the suffixes at anchors (one in ten) have to be sorted; the
  windows around an anchor stand for the rest.
* Digits, most significant first. The first digit is the anchor string: suffixes alone in their group drop out. The
  second is everything that windows with this anchor can reach; groups that are equal in it are repeated windows as a
  whole. Only groups with equal anchors but different surroundings, at the ends of repeats, go on: to the third digit,
  the anchor with what stands before or after it, and where two documents share that, to the windows one by one.

Each pass combines equal suffixes where they are read, so that a group sends a row for each task, not for each
document; rows travel packed in blocks of arrays.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import column, materialise, release, remove, shared_dir, table

WINDOW, DIGIT = 50, 32
SLIDE = WINDOW - DIGIT  # an anchor is this far from its window's start at most
HALF = SLIDE // 2
CHUNK = 1 << 18  # bytes that are hashed at once
FLUSH = 1 << 18  # suffixes that are combined at once
BUCKET_BYTES, PART_BYTES = 4 << 20, 6 << 20
PLACE = 31  # low bits of a position, as no text is longer; above them the number of the text among those with its doc_id
AT = (1 << PLACE) - 1
LAST = (1 << 63) - 1  # stands for a null doc_id
STEP = 7919  # from one mark to the next bucket
#: Bytes of texts for each file of the bucketed table, and its files at most, as Spark has it. A file holds many buckets,
#: which are read one by one, so larger files don't need more memory.
FILE_BYTES, FILES = 16 << 20, 100_000
#: Tasks of an exchange of suffixes at most. Parts, which are held one at a time, grow in number with the input.
TASKS = 100_000
#: Bytes that travel of both digits' hashes, doc and position. The part holds further bits of the first; two first
#: digits that are taken for one only cost work, as the second tells them apart.
WIDTHS = (5, 6, 8, 8)

_U = np.uint64


def _random(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, and powers of an odd base and of its inverse modulo 2^64, up to size."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = int(rng.integers(0, 1 << 61)) * 8 + 5
    powers = lambda b: np.cumprod(np.r_[_U(1), np.full(size, b, np.uint64)], dtype=np.uint64)
    return values, powers(base), powers(pow(base, -1, 1 << 64))


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


class Hashes:
    """Polynomial hashes of any stretch of data, from one running sum."""

    def __init__(self, data: np.ndarray, seed: int):
        if seed not in _tables or len(_tables[seed][1]) <= len(data):
            _tables[seed] = _random(seed, max(len(data), CHUNK + 4 * WINDOW) + 1)
        values, powers, self.back = _tables[seed]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(31)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def pack(*arrays: tuple[np.ndarray, int]) -> bytes:
    """64-bit arrays of one length, of each the given number of low bytes, plane by plane, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for a, n in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for n in widths:
        own = np.zeros((planes.shape[1], 8), np.uint8)
        own[:, :n] = planes[at : at + n].T
        out.append(own.reshape(-1).view(np.uint64))
        at += n
    return out


def pieces(texts: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes, int, int, int]]]:
    """Chunks of pieces (doc, mark, bytes, place of the bytes in the text, first and last window start) of up to
    CHUNK bytes; pieces of long texts overlap, so that each anchor sees all that its windows can reach."""
    out, size = [], 0
    step = CHUNK // 2
    for doc, mark, text in texts:
        last = len(text) - WINDOW
        for a in range(0, last + 1, step):
            b = min(a + step, last + 1)
            low, high = max(0, a - SLIDE), min(len(text), b + WINDOW + 2 * SLIDE)
            if size + high - low > CHUNK:
                yield out
                out, size = [], 0
            out.append((doc, mark, text[low:high], low, a, b, len(text)))
            size += high - low
    if out:
        yield out


def anchors(chunk: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First digit, second digit, doc and position of the anchors of a chunk."""
    data = np.frombuffer(b"".join(p[2] for p in chunk), np.uint8)
    sizes = np.array([len(p[2]) for p in chunk])
    starts = np.cumsum(sizes) - sizes
    own = Hashes(data, 1)
    first = own.every(DIGIT)
    bits = _U((1 << 20) - 1)
    low = (first & ~bits) | np.arange(len(first), dtype=np.uint64)
    for step in (1, 2, 4, 8, SLIDE - 15):  # ends with the smallest of SLIDE + 1 strings from each position on
        low = np.minimum(low[:-step], low[step:])
    open_ = np.zeros(len(data) + 1, np.int8)
    lows, begins, ends = (np.array([p[i] for p in chunk], np.int64) for i in (3, 4, 5))
    np.add.at(open_, starts + begins - lows, 1)
    np.add.at(open_, starts + ends - lows, -1)
    at = low[np.cumsum(open_[: len(low)], dtype=np.int8) > 0] & bits
    at = at[np.r_[True, at[1:] != at[:-1]]].astype(np.int64)
    piece = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[piece] + lows[piece]
    length = np.array([p[6] for p in chunk], np.int64)[piece]
    left, right = np.minimum(SLIDE, place), np.minimum(SLIDE, length - place - DIGIT)
    second = _mixed(own.of(at - left, at + DIGIT + right) + (left * 64 + right + 1).astype(np.uint64))
    docs, marks = (np.array([p[i] for p in chunk], np.int64)[piece] for i in (0, 1))
    return first[at], second, docs, marks << PLACE | place


def sort_digits(first: np.ndarray, second: np.ndarray, doc: np.ndarray, pos: np.ndarray, inner: bool):
    """One pass over suffixes in the order of both digits and doc.

    Returns index arrays: alone (its first digit occurs once), covered (a smaller document has the same second
    digit), again (first in its group of the second digit, which is the only one of its first digit), and onward
    (first in its group, and there are other groups of its first digit). Rows with pos -1 only say that there are
    several groups elsewhere. inner: whether such a row counts as one of a group.
    """
    order = np.argsort(first)
    ranked = first[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]]
    shared = same | np.r_[same[1:], False]
    alone = order[~shared]
    rows = order[shared]
    if not len(rows):
        return alone, rows, rows, rows
    rows = rows[np.lexsort((doc[rows], second[rows], first[rows]))]
    group = np.cumsum(np.r_[0, first[rows][1:] != first[rows][:-1]])
    flag = pos[rows] == -1
    several = np.zeros(group[-1] + 1, bool)
    several[group[flag]] = True
    rows, group = rows[~flag], group[~flag]
    if not len(rows):
        return alone, rows, rows, rows
    new_group = np.r_[True, group[1:] != group[:-1]]
    new_class = new_group | np.r_[True, second[rows][1:] != second[rows][:-1]]
    several[group[new_class & ~new_group]] = True
    least = doc[rows][np.flatnonzero(new_class)][np.cumsum(new_class) - 1]
    later = doc[rows] > least
    onward = several[group] & ~later
    return alone, rows[later], rows[~later & ~onward], rows[onward]


def _row(kind: str, key: int, blob: bytes) -> tuple[str, int, bytes]:
    return kind, int(key), blob


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, keys, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "key", "blob"])


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield keys[rows[0]], rows


def _bucket(doc: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a text: by doc_id, and by what tells apart texts with one doc_id or none."""
    return (doc % buckets + mark * STEP % buckets) % buckets


def _to_docs(kind: str, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[str, int, bytes]]:
    for key, rows in _by_key(_bucket(doc, pos >> PLACE, buckets)):
        rows = rows[np.lexsort((pos[rows], doc[rows]))]
        yield _row(kind, key, pack((doc[rows], 8), (pos[rows], 8)))


def _parts(first: np.ndarray, parts: int) -> np.ndarray:
    return ((first >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _texts(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, bytes]]:
    docs, marks, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "mark", "text"))
    for doc, mark, text in zip(docs.to_pylist(), marks.to_pylist(), texts, strict=True):
        yield doc, mark, text.as_py()


def _first_pass(parts: int, buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, doc, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            alone, covered, again, onward = sort_digits(first, second, doc, pos, False)
            told = np.unique(first[onward])  # two groups are known here: say so once, and go on with the windows
            sent = np.concatenate([alone, again])
            none = np.zeros(len(told), np.int64)
            cols = [np.r_[first[sent], told], np.r_[second[sent], none.astype(np.uint64)], np.r_[doc[sent], none], np.r_[pos[sent], none - 1]]
            out = [_row("suffix", key, pack(*((c[rows], n) for c, n in zip(cols, WIDTHS, strict=True)))) for key, rows in _by_key(_parts(cols[0], parts))]
            out += _to_docs("cover", doc[covered], pos[covered], buckets)
            out += _to_docs("expand", doc[onward], pos[onward], buckets)
            for at in range(0, len(out), 64):
                yield _batch(out[at : at + 64])

        n = 0
        for batch in batches:
            for chunk in pieces(list(_texts(batch))):
                held.append(anchors(chunk))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    return each


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple[str, int, bytes]]]]:
    """Blobs of suffixes by key from rows in the order of kind and key; other rows pass."""
    now, held = None, []
    for batch in batches:
        passing = []
        for kind, key, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
            kind, key, blob = kind.as_py(), key.as_py(), blob.as_py()
            if kind not in ("suffix", "half", "window"):
                passing.append((kind, key, blob))
                continue
            if key != now and held:
                yield now, held, []
                held = []
            now = key
            held.append(blob)
        if passing:
            yield -1, [], passing
    if held:
        yield now, held, []


def _second_pass(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, passing in _grouped(batches):
            out = list(passing)
            if blobs:
                first, second, doc, pos = (np.concatenate(c) for c in zip(*(unpack(b, *WIDTHS) for b in blobs), strict=True))
                doc, pos = doc.view(np.int64), pos.view(np.int64)
                _, covered, _, onward = sort_digits(first, second, doc, pos, True)
                out += _to_docs("cover", doc[covered], pos[covered], buckets)
                out += _to_docs("expand", doc[onward], pos[onward], buckets)
            if out:
                yield _batch(out)

    return each


def _hashed(text: bytes, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of stretches of a text, whose starts ascend; long texts are hashed piece by piece."""
    out, at = [np.zeros((0, len(seeds)), np.uint64)], 0
    while at < len(starts):
        low = starts[at]
        end = np.searchsorted(starts, low + CHUNK)
        data = np.frombuffer(text[low : ends[at:end].max()], np.uint8)
        out.append(np.stack([Hashes(data, s).of(starts[at:end] - low, ends[at:end] - low) for s in seeds], axis=1))
        at = end
    return list(np.concatenate(out).T)


def _reach(places: np.ndarray, length: int) -> np.ndarray:
    """Spans (rows of start, end) that covered anchors stand for: all that their windows can reach."""
    return np.stack([np.maximum(0, places - SLIDE), np.minimum(length, places + WINDOW)], axis=1)


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of spans."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > ends[:-1]])
    return np.stack([spans[new, 0], np.r_[ends[new[1:] - 1], ends[-1]]], axis=1)


def _result(doc: int, mark: int, text: bytes, spans: np.ndarray) -> dict:
    kept, at = hashlib.sha256(), 0
    view = memoryview(text)
    for start, end in spans.tolist():
        kept.update(view[at:start])
        at = end
    kept.update(view[at:])
    return {"doc_id": doc, "mark": mark, "n_bytes": len(text), "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "n_spans": len(spans), "kept_sha256": kept.hexdigest(), "spans": spans.reshape(-1).tolist()}


_RESULT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
RESULT = "doc_id long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _said(table_: pa.Table, kind: str) -> dict[tuple[int, int], np.ndarray]:
    """Positions of a kind by (doc, mark)."""
    doc, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, blob in zip(table_["kind"], table_["blob"], strict=True):
        if k.as_py() == kind:
            d, p = unpack(blob.as_py(), 8, 8)
            doc.append(d.view(np.int64))
            pos.append(p.view(np.int64))
    return _by_text(np.concatenate(doc), np.concatenate(pos))


def _by_text(doc: np.ndarray, pos: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] >> PLACE != pos[:-1] >> PLACE)]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(doc)]
    return {(int(doc[a]), int(pos[a] >> PLACE)): pos[a:b] & AT for a, b in zip(cuts, ends, strict=False)}


def _unknown(starts: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Starts of windows that aren't known to be covered: a window of a covered anchor is an equal of one in a smaller
    document, which stands for it."""
    places = np.r_[np.sort(covered), LAST]
    return starts[places[np.searchsorted(places, starts)] - starts > SLIDE]


_NONE = np.zeros(0, np.int64)
_ROW = pa.schema([("kind", pa.string()), ("key", pa.int32()), ("blob", pa.binary())])


def _table(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)]).cast(_ROW) if rows else _ROW.empty_table()


def _halves(parts: int, buckets: int):
    """The third digit. Every window around an anchor holds the HALF bytes before it or the HALF bytes after it (or
    both). Of each suffix that goes on, the anchor with either is hashed; the side is the hash's lowest bit. Halves that
    two documents of the bucket have are settled here and sent on once, without a document."""

    def each(texts: pa.Table, said: pa.Table) -> pa.Table:
        expand = _said(said, "expand")
        held = [(np.zeros(0, np.uint64), _NONE, _NONE)]
        for doc, mark, text in _texts(texts) if expand else ():
            places = np.unique(expand.get((doc, mark), _NONE))
            for side, start, end in ((0, places - HALF, places + DIGIT), (1, places, places + DIGIT + HALF)):
                good = (start >= 0) & (end <= len(text))
                (own,) = _hashed(text, start[good], end[good], (3 + side,))
                held.append((own & ~_U(1) | _U(side), np.full(len(own), doc), mark << PLACE | places[good]))
        half, doc, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        met, told = _met(half, doc)
        out = [*_sides(half[met], doc[met], pos[met], buckets)]
        none = np.zeros(len(told), np.int64)
        cols = [np.r_[half[~met], told], np.r_[doc[~met], none], np.r_[pos[~met], none - 1]]
        out += [_row("half", key, pack(*((c[rows], n) for c, n in zip(cols, (7, 8, 8), strict=True)))) for key, rows in _by_key(_parts(cols[0] << _U(8), parts))]
        return _table(out)

    return each


def _met(half: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether two documents have each row's hash, and these hashes once each."""
    own, group = np.unique(half, return_inverse=True)
    least, most = np.full(len(own), LAST), np.full(len(own), -LAST)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    several = least < most
    return several[group], own[several]


def _sides(half: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[str, int, bytes]]:
    right = (half & _U(1)) > 0
    yield from _to_docs("left", doc[~right], pos[~right], buckets)
    yield from _to_docs("right", doc[right], pos[right], buckets)


def _half_pass(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, passing in _grouped(batches):
            out = list(passing)
            if blobs:
                half, doc, pos = (np.concatenate(c) for c in zip(*(unpack(b, 7, 8, 8) for b in blobs), strict=True))
                doc, pos = doc.view(np.int64), pos.view(np.int64)
                row = pos != -1
                met, _ = _met(half[row], doc[row])
                met |= np.isin(half[row], half[~row])
                out += _sides(half[row][met], doc[row][met], pos[row][met], buckets)
            if out:
                yield _batch(out)

    return each


def _window_rows(parts: int, buckets: int):
    """The last digit: whole windows on the sides that two documents share. Equals within the bucket are settled here,
    and only those of its smallest document go on."""

    def each(texts: pa.Table, said: pa.Table) -> pa.Table:
        cover, left, right = (_said(said, k) for k in ("cover", "left", "right"))
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), _NONE, _NONE)]
        for doc, mark, text in _texts(texts) if left or right else ():
            before = left.get((doc, mark), _NONE)[:, None] - np.arange(HALF, SLIDE + 1)
            after = right.get((doc, mark), _NONE)[:, None] - np.arange(SLIDE - HALF + 1)
            starts = np.unique(np.r_[before.reshape(-1), after.reshape(-1)])
            starts = _unknown(starts[(starts >= 0) & (starts <= len(text) - WINDOW)], cover.get((doc, mark), _NONE))
            held.append((*_hashed(text, starts, starts + WINDOW, (1, 2)), np.full(len(starts), doc), mark << PLACE | starts))
        one, two, doc, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        one &= _U((1 << 56) - 1)
        two &= _U((1 << 40) - 1)
        later, order = _later(one, two, doc)
        one, two, doc, pos = one[order], two[order], doc[order], pos[order]
        out = [*_to_docs("gone", doc[later], pos[later], buckets)]
        cols = [c[~later] for c in (one, two, doc, pos)]
        out += [_row("window", key, pack(*((c[rows], n) for c, n in zip(cols, (7, 5, 8, 8), strict=True)))) for key, rows in _by_key(_parts(cols[0] << _U(8), parts))]
        return _table(out)

    return each


def _later(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In an order that puts equal windows together, by document: whether a smaller document has the window."""
    order = np.lexsort((doc, two, one))
    if not len(order):
        return np.zeros(0, bool), order
    a, b, d = one[order], two[order], doc[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return d > np.repeat(d[new], np.diff(np.r_[new, len(d)])), order


def _last_pass(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, passing in _grouped(batches):
            out = list(passing)
            if blobs:
                one, two, doc, pos = (np.concatenate(c) for c in zip(*(unpack(b, 7, 5, 8, 8) for b in blobs), strict=True))
                doc, pos = doc.view(np.int64), pos.view(np.int64)
                later, order = _later(one, two, doc)
                out += _to_docs("gone", doc[order][later], pos[order][later], buckets)
            if out:
                yield _batch(out)

    return each


def _settle(texts: pa.Table, said: pa.Table) -> pa.Table:
    cover, gone = _said(said, "cover"), _said(said, "gone")
    out = []
    for doc, mark, text in _texts(texts):
        own = gone.get((doc, mark), _NONE)
        spans = np.concatenate([_reach(cover.get((doc, mark), _NONE), len(text)), np.stack([own, own + WINDOW], axis=1)])
        out.append(_result(doc, mark, text, union(spans)))
    return pa.Table.from_pylist(out, schema=_RESULT)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _bucketed(texts: DataFrame, files: int) -> DataFrame:
    """texts as a table whose files are by bucket, in the shared folder: they are dealt out once, and each pass that
    brings texts and what is known of them together only deals out the latter."""
    spark = texts.sparkSession
    name = f"repeats_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    texts.repartition(files, "bucket").write.bucketBy(files, "bucket").option("compression", "zstd").option("path", path).saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    release(spark)
    return spark.table(name)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and the table with it
        spark.sql(f"drop table if exists {name}")
    remove(spark, path)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (starts and ends of what goes, in bytes) of every
    document: what goes is each byte in a 50-byte string that also starts in a document with a smaller doc_id.

    Takes doc_id and text; other columns are ignored. A null text is empty; texts shorter than a window stay.
    Strings are judged on the input. Rows with equal doc_id never cost each other anything; each gives a row, and equal
    rows are treated as one till the end. A null doc_id counts as larger than all others. Texts that share a doc_id or
    have none are numbered (by their hashes of 128 bits), 2^32 of them at most. An empty table gives an empty result. Very long texts are hashed in
    chunks. Equality is by hashes of 88 bits or more of the strings.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text"))
    size, shared = whole.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), (F.count("*") > 1).alias("shared")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("shared"), F.lit(False))).first()
    numbers = None
    if shared:
        whole = whole.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64("text", F.lit(1))})
        numbers = materialise(_numbered(whole), "numbers")
        whole = whole.dropDuplicates(["doc_id", "one", "two"]).join(numbers.select("doc_id", "one", "two", "mark"), ["doc_id", "one", "two"], "left")
    parts = max(4, -(-size // PART_BYTES))
    buckets = _prime(max(5, -(-size // BUCKET_BYTES)))
    mark = F.coalesce("mark", F.lit(0)) if shared else F.lit(0)
    own = whole.select("doc_id", mark.cast("long").alias("mark"), F.col("text").cast("binary").alias("text"))
    if shared:
        own = materialise(own, "numbered")

    row = "kind string, key int, blob binary"
    place = F.pmod(F.pmod("doc_id", F.lit(buckets)) + F.pmod(F.col("mark") * STEP, F.lit(buckets)), F.lit(buckets)).cast("int")
    by_bucket = _bucketed(own.withColumn("bucket", place), min(FILES, max(8, -(-size // FILE_BYTES)))).groupBy("bucket")

    def passed(rows: DataFrame, one_pass) -> DataFrame:
        """Rows through the tasks of their parts; what is left for the texts is little, and is written, so that the
        exchanged rows can go."""
        out = materialise(rows.repartition(min(parts, TASKS), "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(one_pass, row), "repeats")
        release(docs.sparkSession)
        return out

    said = passed(own.mapInArrow(_first_pass(parts, buckets), row), _second_pass(buckets))
    halves = passed(by_bucket.cogroup(said.where("kind = 'expand'").groupBy("key")).applyInArrow(_halves(parts, buckets), row), _half_pass(buckets))
    cover = said.where("kind = 'cover'")
    gone = passed(by_bucket.cogroup(cover.union(halves).groupBy("key")).applyInArrow(_window_rows(parts, buckets), row), _last_pass(buckets))
    out = by_bucket.cogroup(cover.union(gone).groupBy("key")).applyInArrow(_settle, RESULT)
    if shared:  # a row for each of those that are equal
        times = numbers.where("n > 1").select("doc_id", "mark", "n")
        out = out.join(times, ["doc_id", "mark"], "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))))
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), *(f for f in _RESULT.names if f not in ("doc_id", "mark")))


def _numbered(whole: DataFrame) -> DataFrame:
    """doc_id, one, two (hashes of the text), mark and n of the texts that share their doc_id with other rows: each text's own number,
    so that texts with one doc_id, or with none, are told apart exactly, and its rows."""
    texts = whole.groupBy("doc_id", "one", "two").agg(F.count("*").alias("n"))
    several = texts.groupBy("doc_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("doc_id")
    ranked = materialise(texts.join(several, "doc_id"), "texts").rdd.zipWithIndex()
    return whole.sparkSession.createDataFrame(ranked.map(lambda x: (*x[0], x[1])), "doc_id long, one long, two long, n long, mark long")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
