"""Near copies at a Jaccard similarity of 0.8: wide SimHash fingerprints met through Golay keys, completed exactly.

Golay keys of two of five segments bring together nearly all fingerprints that are a few bits apart, however large a
family of near copies is; each link is verified by the shingle sets. Pairs right at 0.8 differ in 17 of 115 bits on
average, and no number of codeword keys that a corpus can afford reaches all of these. So what is still in different
components is joined by prefixes of the shingle sets, which no similar pair can escape, and verified in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import golay
from heliograph.llm.common import column, discard, materialise, private, restored, text_bytes
from heliograph.llm.components import components
from heliograph.llm.forest import Forest
from heliograph.llm.repeats import TASKS, pack, unpack

WIDTH = 5
#: Documents are linked from a Jaccard similarity of OVER / UNDER.
OVER, UNDER = 4, 5
SEGMENTS = 5
BITS = SEGMENTS * golay.BITS
#: Bits in which fingerprints that meet under a Golay key may differ: most such pairs hold when they are verified.
MOST = 14
WAYS = [(i, j) for j in range(SEGMENTS) for i in range(j)]
#: Texts up to which a shingle counts as rare, and shingles, at most, whose counts are sent to all tasks: the commonest of all.
#: The order only keeps groups small: similar sets meet under any order.
RARE, COMMON = 16, 1 << 20
#: Shingles whose counts are combined before they travel, and shingles, about, for each part in which they are summed.
COUNTED, PART_SHINGLES = 1 << 19, 1 << 21
NODES = 2048  # sets whose keys are packed at once
PART_NODES = 4096  # sets for each part of the Golay keys
PART_KEYS = 1 << 21  # prefix keys for each part
#: Members of a prefix key from which it is dealt into blocks of half as many.
HOT = 4096
#: The table in which keys are counted before those of full cells are counted exactly, and the slices it travels in.
CELL_BITS, SLICES = 20, 16
#: Sets whose texts are found by sending their names to all tasks, and hot keys that are sent at a time; more sets are joined.
SENT = 500_000
#: Members of a key from which they are first paired with one of them.
STAR = 8
#: Bits in which fingerprints of similar sets may differ, from so many shingles on. At 0.8 they differ in 17.4 on average,
#: with a deviation of 3.9, so that the odds of more are one in a hundred million.
FAR, LARGE = 40, 50
#: Counts of a sketch, which rules out most pairs before their sets meet.
BUCKETS = 256
_U = np.uint64
LINKS = "a long, b long"


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set of word shingles as sorted XXH3; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s)) for s in runs), np.uint64))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """115 bits of a set in two numbers: a bit is 1 if it is set in more than half of the shingles' 128-bit hashes."""
    if not len(own):
        return 0, 0
    ones = np.zeros(128, np.int64)
    for at in range(0, len(own), 1 << 15):
        part = own[at : at + (1 << 15)]
        both = np.stack([part, _spread(part)], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(own)
    bits[BITS:] = False
    return tuple(np.packbits(bits, bitorder="little").view(np.uint64).tolist())


def _spread(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h ^ _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    h = h * _U(0x94D049BB133111EB)
    return h ^ h >> _U(29)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by (texts that hold it, hash): two similar sets share one of them, whatever the counts are. common: the
    high 48 bits of shingles that many texts hold, sorted."""
    most = len(own) + (-OVER * len(own) // UNDER) + 1  # n - ceil(0.8 n) + 1
    if not len(own) or not len(common):
        return own[:most] if len(own) else own
    high = own >> _U(16)
    at = np.minimum(np.searchsorted(common, high), len(common) - 1)
    return own[np.argsort(np.where(common[at] == high, counts[at], 0), kind="stable")[:most]]


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall into each of BUCKETS, at most 255."""
    return np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The high 48 bits of shingles that more than RARE texts hold, sorted, and how many do: all texts are counted. If these are
    more than COMMON, only those above the least count that leaves no more."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(max(4, size // 6 // PART_SHINGLES), 1 << 15)  # about six bytes a word
    held = materialise(_dealt(texts.select("text").mapInArrow(_send_counts(parts, width), PACKED), parts).mapInArrow(_receive_counts, "key long, n long"), "near-common")
    by = sorted(held.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("keys")).collect(), reverse=True)  # a row for each count
    least, total = RARE, 0
    for n, keys in by:
        total += keys
        if total > COMMON:
            least = n
            break
    rows = held.where(F.col("n") > least).toArrow()  # bounded
    discard(held)
    keys, counts = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _send_counts(parts: int, width: int):
    """By part, shingles that stand once among some texts, and those that stand several times with how often."""

    def packed(own: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(own) >> _U(16), return_counts=True)
        part = (key * _U(parts) >> _U(48)).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(key) else np.zeros(0, np.int64)
        once, several = [], []
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True) if len(key) else ():
            more = n[s:e] > 1
            once.append(pack((key[s:e][~more], 6)))
            several.append(pack((key[s:e][more], 6), (n[s:e][more], 4)))
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(once, pa.binary()), pa.array(several, pa.binary())], ["part", "rows", "nodes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            for t in text_bytes(batch):
                own.append(shingles(t, width))
                size += len(own[-1])
                if size >= COUNTED:
                    yield packed(own)
                    own, size = [], 0
        if size:
            yield packed(own)

    return each


def _receive_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and n of a part's shingles that more than RARE texts hold."""
    for held in _by_part(batches):
        once = np.concatenate([unpack(r, 6)[0] for r, _ in held])
        several, n = (np.concatenate(c) for c in zip(*(unpack(t, 6, 4) for _, t in held), strict=True))
        key, at = np.unique(np.concatenate([once, several]), return_inverse=True)
        counts = np.bincount(at[: len(once)], minlength=len(key)) + np.bincount(at[len(once) :], n, minlength=len(key)).astype(np.int64)
        some = counts > RARE
        yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(counts[some])], ["key", "n"])


# -- Golay keys ------------------------------------------------------------------------------------------------------


def golay_keys(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of each fingerprint under every two codeword indices near two of its segments."""
    mask = _U((1 << 23) - 1)
    parts = [lo & mask, lo >> _U(23) & mask, (lo >> _U(46) | hi << _U(18)) & mask, hi >> _U(5) & mask, hi >> _U(28) & mask]
    near = []
    for part in parts:
        found = golay.near(part.astype(np.int32))
        order = np.argsort(found < 0, axis=1, kind="stable")[:, :6]  # at most six are different
        near.append(np.take_along_axis(found, order, axis=1))
    at, out = [], []
    for way, (x, y) in enumerate(WAYS):
        a, b = near[x][:, :, None], near[y][:, None, :]
        n, i, j = np.nonzero((a >= 0) & (b >= 0))
        at.append(n)
        out.append(way << 24 | near[x][n, i].astype(np.int64) << 12 | near[y][n, j])
    return np.concatenate(at), np.concatenate(out)


def _packed(parts: np.ndarray, rows: list[tuple[np.ndarray, int]], at: np.ndarray, nodes: list[tuple[np.ndarray, int]], key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by part: each part's rows, sorted by key, and the nodes that they point to."""
    order = np.lexsort((key, parts))
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    out: list[tuple[int, bytes, bytes]] = []
    for own in np.split(order, cuts) if len(order) else ():
        used, place = np.unique(at[own], return_inverse=True)
        out.append((int(parts[own[0]]), pack(*((c[own], n) for c, n in rows), (place.astype(np.int64), 2)), pack(*((c[used], n) for c, n in nodes))))
    for k in range(0, len(out), 64):
        part, blob, table = zip(*out[k : k + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary()), pa.array(table, pa.binary())], ["part", "rows", "nodes"])


PACKED = "part int, rows binary, nodes binary"


def _opened(held: list[tuple[bytes, bytes]], rows: tuple[int, ...], nodes: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of a part's rows, the last pointing into the columns of its nodes."""
    some = [unpack(r, *rows, 2) for r, _ in held]
    tables = [unpack(t, *nodes) for _, t in held]
    shift = np.cumsum([0, *(len(t[0]) for t in tables)])
    columns = [np.concatenate(c).view(np.int64) for c in zip(*some, strict=True)]
    columns[-1] = np.concatenate([s[-1].astype(np.int64) + at for s, at in zip(some, shift, strict=False)])
    return columns, [np.concatenate(c) for c in zip(*tables, strict=True)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    now, held = None, []
    for batch in batches:
        for part, rows, nodes in zip(*(column(batch, c) for c in ("part", "rows", "nodes")), strict=True):
            if part.as_py() != now and held:
                yield held
                held = []
            now = part.as_py()
            held.append((rows.as_py(), nodes.as_py()))
    if held:
        yield held


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, i, j) of all pairs i < j of small groups with these sizes, some half a million at a time."""
    work = sizes**2
    for runs in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(work) >> 19)) + 1):
        n = work[runs]
        run = np.repeat(runs, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = k // sizes[run], k % sizes[run]
        half = i < j
        yield run[half], i[half], j[half]


def _send_golay(parts: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [column(batch, c).to_numpy().view(np.uint64) for c in ("node", "lo", "hi")]
            for start in range(0, len(every[0]), NODES):
                node, lo, hi = (e[start : start + NODES] for e in every)
                at, key = golay_keys(lo, hi)
                yield from _packed((key * 0x9E3779B1 % (1 << 32) * parts) >> 32, [(key, 4)], at, [(node, 8), (lo, 8), (hi, 7)], key)

    return each


def meet(key: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices of prints) within MOST bits among rows with equal keys, as many as join the components.

    Of a large group only what isn't in one component yet is compared, first with one of its members, then block by
    block: a family of near copies shares many keys, and all but the first find it joined.
    """
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    forest = Forest(len(lo))
    out = [(np.zeros(0, np.int64),) * 2]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        apart = forest.root[a] != forest.root[b]
        a, b = a[apart], b[apart]
        good = np.bitwise_count(lo[a] ^ lo[b]).astype(np.int16) + np.bitwise_count(hi[a] ^ hi[b]) <= MOST
        a, b = a[good], b[good]
        kept = forest.add(a, b)
        if len(kept):
            out.append((a[kept], b[kept]))

    small = sizes <= 512
    first = starts[small]
    for run, i, j in _pairs(sizes[small]):
        take(at[first[run] + i], at[first[run] + j])
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        own = at[s : s + n]
        for hub in (own[0], own[n // 2]):
            take(np.full(n, hub), own)
        for i in range(0, n, 512):
            if (forest.tops(own) == forest.tops(own[:1])).all():
                break
            for j in range(i, n, 512):
                a, b = own[i : i + 512], own[j : j + 512]
                take(np.repeat(a, len(b)), np.tile(b, len(a)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _receive_golay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _by_part(batches):
        (key, at), (node, lo, hi) = _opened(held, (4,), (8, 8, 7))
        a, b = meet(key, at, lo, hi)
        if len(a):
            yield _links(node.view(np.int64)[a], node.view(np.int64)[b])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def golay_links(nodes: DataFrame, n: int) -> DataFrame:
    """Candidate links (a, b) of n sets (node, lo, hi) by the Golay keys of their fingerprints."""
    parts = max(4, -(-n // PART_NODES))
    sent = nodes.select("node", "lo", "hi").mapInArrow(_send_golay(parts), PACKED)
    return _dealt(sent, parts).mapInArrow(_receive_golay, LINKS).distinct()


def _dealt(sent: DataFrame, parts: int) -> DataFrame:
    """Rows by part. Parts grow in number with the input; a task has several, one after another."""
    return sent.repartition(min(parts, TASKS), "part").sortWithinPartitions("part")


# -- prefixes --------------------------------------------------------------------------------------------------------


def _cells(keys: np.ndarray) -> np.ndarray:
    return (_spread(keys.view(np.uint64)) >> _U(64 - CELL_BITS)).astype(np.int64)


def _hot_keys(nodes: DataFrame) -> DataFrame:
    """key and n of the keys with more than HOT members.

    Keys are first counted in a table of fixed size; those in a cell with more than HOT members are then counted exactly,
    combined before the exchange. How rows are dealt to partitions makes no difference.
    """
    width = (1 << CELL_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            counts += np.bincount(_cells(column(batch, "keys").flatten().to_numpy()), minlength=len(counts))
        if counts.any():
            blobs = [pack((counts[k * width : (k + 1) * width], 8)) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(blobs, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(column(batch, "slice").to_pylist(), column(batch, "counts"), strict=True):
                sums[k] = sums.get(k, 0) + unpack(blob.as_py(), 8)[0].view(np.int64)
        full = [np.packbits(n > HOT, bitorder="little").tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(full, pa.binary())], ["slice", "bits"])

    keys = nodes.select("keys")
    rows = keys.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, bits binary").collect()  # 128 KB
    full = {r["slice"]: np.frombuffer(r["bits"], np.uint8) for r in rows}
    bits = np.concatenate([full.get(k, np.zeros(width // 8, np.uint8)) for k in range(SLICES)])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = column(batch, "keys").flatten().to_numpy()
            cell = _cells(own)
            own, n = np.unique(own[bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["key", "n"])

    return keys.mapInArrow(told, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)


def _some_hot(hot: DataFrame, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot keys of a turn, sorted, and in how many blocks they are dealt."""
    some = hot.where(F.pmod(F.col("key").bitwiseAND(0xFFFF), F.lit(turns)) == turn).toArrow()
    keys, n = some["key"].to_numpy(), some["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-2 * n[order] // HOT)


def _send_prefixes(parts: int, hot: np.ndarray, blocks: np.ndarray, turn: int, turns: int):
    """Prefix keys of a turn with the place of each in its set's order. The members of a hot key are dealt into blocks, and every
    two blocks meet in a cell, which is a key of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, NODES):
                part = batch.slice(start, NODES)
                node, class_, n, lo, hi = (column(part, c).to_numpy().astype(np.int64) for c in ("node", "class", "n", "lo", "hi"))
                lists = column(part, "keys")
                lengths = np.diff(lists.offsets.to_numpy())
                key = lists.flatten().to_numpy()
                at = np.repeat(np.arange(len(node)), lengths)
                place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                place = place * 1200 // n[at]  # the prefix ends at a fifth: one byte
                if turns > 1:
                    own = (key & 0xFFFF) % turns == turn
                    key, at, place = key[own], at[own], place[own]
                if len(hot):
                    where = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    dealt = np.flatnonzero(hot[where] == key)
                    count = blocks[where[dealt]]
                    own = (_spread(node.view(np.uint64)[at[dealt]]) % count.astype(np.uint64)).astype(np.int64)
                    copy = np.repeat(np.arange(len(dealt)), count - 1)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(count - 1) - (count - 1), count - 1)
                    mine = own[copy]
                    other += other >= mine
                    cell = _spread(key[dealt][copy].view(np.uint64) + _U(0x9E3779B1) * (np.minimum(mine, other) * 65537 + np.maximum(mine, other)).astype(np.uint64)).view(np.int64)
                    rest = np.ones(len(key), bool)
                    rest[dealt] = False
                    key, at, place = np.r_[key[rest], cell], np.r_[at[rest], at[dealt][copy]], np.r_[place[rest], place[dealt][copy]]
                mixed = _spread(key.view(np.uint64))
                to = ((mixed >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
                low = (mixed & _U((1 << 40) - 1)).view(np.int64)
                yield from _packed(to, [(low, 5), (place, 1)], at, [(node, 8), (class_, 8), (n, 4), (lo, 8), (hi, 7)], low)

    return each


def fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)


@dataclass
class Sets:
    """What a part knows of its sets: node, class, size and fingerprint."""

    node: np.ndarray
    class_: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def may(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets of different classes that share a key at these places of their orders can be similar, if it is
        the first that they share; if it isn't, the first one lets them meet."""
        n, m = self.n[a], self.n[b]
        most = 1 + np.minimum(n - 1 - i * n // 1200, m - 1 - j * m // 1200)
        good = (self.class_[a] != self.class_[b]) & fit(n, m) & ((OVER + UNDER) * most >= OVER * (n + m))
        left = np.flatnonzero(good)
        x, y = a[left], b[left]
        apart = np.bitwise_count(self.lo[x] ^ self.lo[y]).astype(np.int16) + np.bitwise_count(self.hi[x] ^ self.hi[y])
        good[left] = (apart <= FAR) | (np.minimum(n[left], m[left]) < LARGE)
        return good


def candidates(key: np.ndarray, place: np.ndarray, at: np.ndarray, sets: Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different classes that share a key and may be similar."""
    order = np.lexsort((sets.n[at], key))
    key, place, at = key[order], place[order], at[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    # the keys of one class need no pairs
    own = sets.class_[at]
    several = np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts)
    starts, sizes = starts[several], sizes[several]

    def take(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = at[x], at[y]
        good = sets.may(a, place[x], b, place[y])
        return sets.node[a[good]], sets.node[b[good]]

    small = sizes <= 512
    first = starts[small]
    for run, i, j in _pairs(sizes[small]):
        yield take(first[run] + i, first[run] + j)
    for s, size in zip(starts[~small], sizes[~small], strict=True):  # in the order of sizes, block by block
        for i in range(s, s + size, 512):
            x = np.arange(i, min(i + 512, s + size))
            end = s + np.searchsorted(sets.n[at[s : s + size]], UNDER * sets.n[at[x[-1]]] // OVER, side="right")
            for j in range(i, end, 512):
                y = np.arange(j, min(j + 512, end))
                a, b = np.repeat(x, len(y)), np.tile(y, len(x))
                yield take(a[a < b], b[a < b])


def stars(key: np.ndarray, place: np.ndarray, at: np.ndarray, sets: Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each larger group's members with the one that has the fewest rarer shingles. What is rare in a family of
    near copies are the changes, so that is the member nearest to what they were copied from."""
    order = np.lexsort((sets.node[at], place, key))
    key, place, at = key[order], place[order], at[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    hub = np.repeat(starts, sizes)
    a, b = at[hub], at
    good = np.repeat(sizes >= STAR, sizes) & sets.may(a, place[hub], b, place)
    yield sets.node[a[good]], sets.node[b[good]]


def _receive_prefixes(pairs):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            (key, place, at), (node, class_, n, lo, hi) = _opened(held, (5, 1), (8, 8, 4, 8, 7))
            sets = Sets(*(c.view(np.int64) for c in (node, class_, n)), lo, hi)
            found, size = [], 0
            for a, b in pairs(key, place, at, sets):
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                size += len(a)
                if size > 1 << 20:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    size = 0
                    if found[0].shape[1] > 1 << 20:
                        yield _links(*found.pop())
            if found:
                yield _links(*np.unique(np.concatenate(found, axis=1), axis=1))

    return each


def prefix_links(nodes: DataFrame, hot: DataFrame, total: int, pairs) -> DataFrame:
    """Candidate links (a, b) between sets (node, class, n, lo, hi, keys) of different classes that share a prefix key: stars,
    or all candidates. hot: key and n of the keys with more than HOT members; SENT of them are sent to all tasks at a time, and
    if there are more, the keys are gone through in several turns."""
    turns = max(1, -(-hot.count() // SENT))
    parts = max(4, -(-total // PART_KEYS))
    sent = reduce(DataFrame.union, (nodes.mapInArrow(_send_prefixes(parts, *_some_hot(hot, k, turns), k, turns), PACKED) for k in range(turns)))
    return _dealt(sent, parts).mapInArrow(_receive_prefixes(pairs), LINKS).distinct()


# -- verification ----------------------------------------------------------------------------------------------------


def _both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """Pairs with what belongs to either of their nodes."""
    left = pairs.join(of.select(F.col("node").alias("a"), F.col(name).alias("left")), "a")
    return left.join(of.select(F.col("node").alias("b"), F.col(name).alias("right")), "b")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two sets have no more in common than the lesser counts of their sketches add up to; a full count bounds nothing."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("left", "right"))
        full = (x == 255).any(1) | (y == 255).any(1)
        both = np.minimum(x, y).sum(1, dtype=np.int64)
        size = x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(full | ((OVER + UNDER) * both >= OVER * size)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = zip(*(column(batch, c) for c in ("left", "right")), strict=True)
        good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in every]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, label: str) -> DataFrame:
    """Those of the candidate links whose sets are similar.

    nodes: node, doc, mark (of one text) and sketch. Only texts of candidates that their sketches leave are read into sets.
    """
    pairs = materialise(pairs, f"{label}-pairs")
    left = materialise(_both(pairs, nodes, "sketch").mapInArrow(_sketched, LINKS), f"{label}-left")
    discard(pairs)
    wanted = materialise(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc", "mark"), "node"), f"{label}-wanted")
    side = F.broadcast(wanted) if wanted.count() <= SENT else wanted  # 24 bytes each; else both sides are dealt out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([shingles(t, width).tobytes() for t in text_bytes(batch)], pa.binary())], ["node", "own"])

    same = (F.col("w.mark") == F.col("t.mark")) & F.col("w.doc").eqNullSafe(F.col("t.doc_id"))
    # repeated rows of a text are one
    sets = texts.alias("t").join(side.alias("w"), same).select("node", "text").dropDuplicates(["node"]).mapInArrow(each, "node long, own binary")
    sets = materialise(sets, f"{label}-sets")
    out = materialise(_both(left, sets, "own").mapInArrow(_verified, LINKS), f"{label}-links")
    discard(sets, left, wanted)
    return out


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id stays.

    Documents are linked if the Jaccard similarity of their sets of word shingles is 0.8 or more; groups are connected
    components, and no link is lost. Takes doc_id and text; all columns stay, whatever their names. A null doc_id counts
    as largest, equal doc_ids are ordered by a hash of the text, and of repeated rows one stays. Null and empty texts are
    copies of each other. Equal sets (by 128 bits) are one node, so the number of copies doesn't matter. A very long text
    is one set of as many shingles. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    common, counts = _common(texts, width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "name", "n", "lo", "hi", "sketch", "keys"]
        for batch in batches:
            own = [shingles(t, width) for t in text_bytes(batch)]
            prints = np.array([fingerprint(s) for s in own], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, c) for c in names[:2]),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
                    pa.array([len(s) for s in own], pa.int32()),
                    *(pa.array(prints[:, k]) for k in range(2)),
                    pa.array([sketch(s) for s in own], pa.binary()),
                    pa.array([prefix(s, common, counts).view(np.int64) for s in own], pa.list_(pa.int64())),
                ],
                names,
            )

    marks = materialise(texts.mapInArrow(each, "doc_id long, mark long, name binary, n int, lo long, hi long, sketch binary, keys array<long>"), "near-marks")
    # a row for each set: copies are combined by a minimum of slim rows, and only the first one's columns are fetched
    first = marks.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "mark")).alias("first"))
    first = first.select("first", "first.doc", "first.mark", "name", F.xxhash64("name", "first.doc", "first.mark").alias("id"))
    own = marks.select(F.xxhash64("name", "doc_id", "mark").alias("id"), "name", "n", "lo", "hi", "sketch", "keys")
    heads = first.join(own, ["id", "name"]).dropDuplicates(["id", "name"]).drop("name")
    heads = materialise(heads.withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("id", "node"), "near-heads")
    repeated = marks.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count() > 0
    discard(marks)
    total, keys = heads.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    links = verified(golay_links(heads, total), heads, texts, width, "golay")
    # families are joined by stars before the rest is paired, so that a large one isn't turned into its pairs
    hot = materialise(_hot_keys(heads), "near-hot")
    for pairs in (stars, candidates):
        class_of = materialise(components(links), "near-classes")
        apart = heads.select("node", "n", "lo", "hi", "keys").join(class_of, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "n", "lo", "hi", "keys")
        apart = materialise(apart, "near-apart")
        links = links.union(verified(prefix_links(apart, hot, keys, pairs), heads, texts, width, "prefix"))
        discard(apart, class_of)
    found = materialise(components(links), "near-classes")
    kept = heads.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = materialise(kept.select(F.col("first.doc").alias("_doc"), F.col("first.mark").alias("_mark")), "near-kept")
    discard(heads, found, hot)
    rows = private(docs, "doc_id", "text")
    own = (F.xxhash64(text) == F.col("_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))
    out = rows.join(kept, own, "left_semi")
    if repeated:  # one of repeated rows stays
        out = out.withColumn("_mark", F.xxhash64(text)).dropDuplicates(["doc_id", "_mark"])
    return restored(out, docs, "doc_id", "text")
