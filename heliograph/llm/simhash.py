"""SimHash near-duplicates: fingerprints whose segments are decoded by the Golay code and joined by its codewords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import golay
from heliograph.llm.common import column, materialise, table, text_bytes
from heliograph.llm.components import components
from heliograph.llm.forest import Forest

SHINGLE, SEED, MOST = 3, 42, 3
#: Lowest bit and width of the segments; the last is filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Of three segments with three errors at most, two have one error at most: every pair of segments is a way to meet.
WAYS = ((0, 1), (0, 2), (1, 2))
#: Rows of a key from which it is dealt into blocks, and rows or probes of a block.
HOT = 4096


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the XXH64 of the word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z only; ASCII white space only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every whole text; no exchange."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, width) for t in text_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def _keys(own: np.ndarray, probe: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each way, (index into own, key): the decoded indices of both segments; for a probe all nearby ones."""
    parts = [(own >> np.uint64(low) & np.uint64((1 << wide) - 1)).astype(np.int32) for low, wide in SEGMENTS]
    found = [golay.near(p) if probe else golay.decode(p)[:, None] for p in parts]
    for way, (x, y) in enumerate(WAYS):
        a, b = found[x][:, :, None], found[y][:, None, :]
        at, i, j = np.nonzero((a >= 0) & (b >= 0))
        yield at, way << 24 | found[x][at, i].astype(np.int64) << 12 | found[y][at, j]


def _keyed(nodes: DataFrame, probe: bool) -> DataFrame:
    """key, fp and side of each distinct fingerprint: 3 rows as data, 27 times as many at most on average as a probe."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = column(batch, "fp").to_numpy().view(np.uint64)
            for start in range(0, len(every), 2048):
                own = every[start : start + 2048]
                for at, key in _keys(own, probe):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[at].view(np.int64)), pa.array(np.full(len(at), probe))], ["key", "fp", "probe"])

    return nodes.select("fp").mapInArrow(each, "key long, fp long, probe boolean")


def _forest(data: np.ndarray, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Enough links within MOST bits between data and probes to keep their components, for a key with many rows.

    Rows are compared in blocks; of those whose numbers of ones differ by more than MOST, none are compared. A row
    that already belongs to a component with a row of the block isn't linked to it again.
    """
    nodes = np.unique(np.concatenate([data, probes]))
    forest = Forest(len(nodes))

    def by_ones(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = np.bitwise_count(x)
        order = np.argsort(ones, kind="stable")
        return x[order], ones[order].astype(np.int64)

    (a, ones_a), (b, ones_b) = by_ones(data), by_ones(probes)
    for i in range(0, len(a), 1024):
        block = a[i : i + 1024]
        low = np.searchsorted(ones_b, ones_a[i] - MOST)
        high = np.searchsorted(ones_b, ones_a[min(i + 1023, len(a) - 1)] + MOST, side="right")
        for j in range(low, high, 1024):
            other = b[j : min(j + 1024, high)]
            x, y = np.nonzero(np.bitwise_count(block[:, None] ^ other) <= MOST)
            left, right = np.searchsorted(nodes, block[x]), np.searchsorted(nodes, other[y])
            kept = forest.add(left, right)
            if len(kept):
                yield nodes[left[kept]], nodes[right[kept]]


def _matches(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows that are sorted by key."""
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    probes = np.add.reduceat(probe.astype(np.int64), starts)
    data = ends - starts - probes
    order = np.lexsort((probe, np.repeat(np.arange(len(starts)), ends - starts)))  # in each run data first, then probes
    fp = fp[order]
    work = data * probes
    for r in np.flatnonzero(work > 1 << 16):
        yield from _forest(fp[starts[r] : starts[r] + data[r]], fp[starts[r] + data[r] : ends[r]])
    runs = np.flatnonzero((work > 0) & (work <= 1 << 16))
    for some in np.split(runs, np.flatnonzero(np.diff(np.cumsum(work[runs]) >> 20)) + 1):
        n = work[some]
        run = np.repeat(np.arange(len(some)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = fp[starts[some][run] + k // probes[some][run]]
        b = fp[starts[some][run] + data[some][run] + k % probes[some][run]]
        good = (np.bitwise_count(a ^ b) <= MOST) & (a != b)
        yield a[good], b[good]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key; the rows of a last key wait for the next batch."""
    rest: list[np.ndarray] | None = None
    parts: list[list[np.ndarray]] = []

    def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in _matches(*cols):
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [column(batch, "key").to_numpy(), column(batch, "fp").to_numpy().view(np.uint64), column(batch, "probe").to_numpy(zero_copy_only=False)]
        if not len(cols[0]):
            continue
        cut = np.searchsorted(cols[0], cols[0][-1])
        if cut == 0 and rest is not None and rest[0][0] == cols[0][0]:
            parts.append(cols)
            continue
        whole = [np.concatenate([*(p[i] for p in parts), cols[i][:cut]]) for i in range(3)]
        yield from links(whole)
        parts = [[c[cut:] for c in cols]]
        rest = parts[0]
    if parts:
        yield from links([np.concatenate([p[i] for p in parts]) for i in range(3)])


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that keep all components of "within MOST bits".

    Every fingerprint is data under the codeword indices of two of its segments, and a probe under all pairs of
    indices near them. Two fingerprints within three bits have two segments with one error at most each; there
    the probe holds the other's own index, so they meet, and their distance is checked. Of a key with more than HOT
    rows of data, rows and probes are dealt into blocks of about HOT; every two blocks meet in a task of their own, so no
    task holds more than two blocks of a key. A task emits every link of small keys, but for large keys
    only as many as hold their components together: a large group of near copies doesn't become all its pairs.
    """
    data, probes = _keyed(nodes, False), _keyed(nodes, True)
    hot = materialise(data.groupBy("key").count().where(F.col("count") > HOT), "hot-keys")
    n = hot.count()
    if n:
        side = F.broadcast(hot) if n <= 100_000 else hot  # 16 bytes each
        asked = probes.join(side.select("key"), "key").groupBy("key").agg(F.count("*").alias("probes"))
        hot = materialise(hot.join(asked, "key", "left").select("key", *(F.greatest(F.ceil(F.coalesce(c, F.lit(0)) / HOT), F.lit(1)).cast("int").alias(b) for c, b in ((F.col("count"), "rows"), (F.col("probes"), "columns")))), "hot-blocks")
        side = F.broadcast(hot) if n <= 100_000 else hot
        # a grid for each hot key: a row meets every block of probes, a probe every block of rows
        one = lambda c: F.coalesce(F.col(c), F.lit(1))
        block = lambda c: F.pmod(F.xxhash64("fp"), one(c))
        every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
        cell = F.pmod(F.col("i") * 1021 + F.col("j"), F.lit(1 << 20)).alias("salt")
        data = data.join(side, "key", "left").withColumn("i", block("rows")).withColumn("j", every("columns")).select("key", "fp", "probe", cell)
        probes = probes.join(side, "key", "left").withColumn("j", block("columns")).withColumn("i", every("rows")).select("key", "fp", "probe", cell)
    else:
        data, probes = data.withColumn("salt", F.lit(0)), probes.withColumn("salt", F.lit(0))
    salt = F.col("salt")
    # 48 salted bits in one number keep the sorted rows short
    rows = data.union(probes).select((F.col("key") * (1 << 20) + salt).alias("key"), "fp", "probe")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that can be reached over links within MOST bits) of every document.

    Takes doc_id and text; other columns are ignored. A-Z are lower-cased; words are what ASCII white space
    separates; fewer words than a shingle are one shingle; a null or empty text has fingerprint 0 and is linked
    like any other. Equal fingerprints are one node, whatever their number, so a group of copies is never paired.
    Rows with a null doc_id link like any other; a component of such rows only has a null one. Rows that share a doc_id
    each belong to the component of their own text. Repeated rows each give a row. An empty table gives an empty result.
    """
    marks = materialise(fingerprints(docs, width), "fingerprints")
    nodes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    class_of = components(links(nodes)).withColumnRenamed("node", "fp")
    named = nodes.join(class_of, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marks.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
