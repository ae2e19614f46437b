"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import column, materialise, private, restored, table, text_bytes
from heliograph.llm.repeats import Hashes

#: Words of the shortest tile, and share of an item's words that tiles must cover. An item of fewer words has to stand
#: as a whole.
TILE, COVERAGE = 5, 0.6
#: Documents that hold a seed from which it is dealt to several tasks, of about as many documents each.
HOT = 1 << 16
#: Size of the filter of item seeds, in bits: 8 MB, whatever the size of the benchmark.
FILTER_BITS = 26
CHUNK = 1 << 20

#: Upper case to lower case, and every ASCII character that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _seed_chunk(parts: list[tuple[int, list[bytes]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = [np.fromiter(map(len, w), np.int64, len(w)) + 1 for _, w in parts]
    data = np.frombuffer(b" ".join(b" ".join(w) for _, w in parts), np.uint8)
    lengths = np.concatenate(sizes)
    starts = np.cumsum(lengths) - lengths
    n = np.array([len(s) for s in sizes])
    owner = np.repeat(np.arange(len(parts)), n)
    first = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
    hashes = Hashes(data, 1).of(starts[first], starts[first + width - 1] + lengths[first + width - 1] - 1)
    return np.array([i for i, _ in parts])[owner[first]], hashes


def seeds(texts: list[bytes | None], width: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash) of every run of `width` words; long texts are cut into pieces that overlap."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for i, text in enumerate(texts):
        own = words(text)
        step = max(width, CHUNK // 8)
        for at in range(0, len(own) - width + 1, step):
            part = own[at : at + step + width - 1]
            held.append((i, part))
            size += sum(map(len, part)) + len(part)
            if size >= CHUNK // 2:
                yield _seed_chunk(held, width)
                held, size = [], 0
    if held:
        yield _seed_chunk(held, width)


def tiles(item: list, doc: list, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, words), longest first, each word in one tile at most.

    Running Karp-Rabin hashes of `least` words find where matches begin; each is extended as far as it goes. The
    longest is marked first; a match that meets marked words goes back with what is left of it.
    """
    if min(len(item), len(doc)) < least:
        return []
    codes = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [codes[w] for w in item], [codes.get(w, 0) for w in doc]
    top = pow(_BASE, least - 1, _PRIME)

    def running(line: list[int]) -> Iterator[tuple[int, int]]:
        h = 0
        for k, c in enumerate(line):
            if k >= least:
                h = (h - line[k - least] * top) % _PRIME
            h = (h * _BASE + c) % _PRIME
            if k >= least - 1:
                yield k - least + 1, h

    places = defaultdict(list)
    for i, h in running(a):
        places[h].append(i)
    heap: list[tuple[int, int, int]] = []
    for j, h in running(b):
        for i in places.get(h, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # a longer match began before
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                heap.append((-n, i, j))
    heapq.heapify(heap)
    in_item, in_doc = bytearray(len(a)), bytearray(len(b))
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        if not any(in_item[i : i + n]) and not any(in_doc[j : j + n]):
            in_item[i : i + n] = in_doc[j : j + n] = b"\1" * n
            out.append((i, j, n))
            continue
        start = None
        for k in range(n + 1):
            free = k < n and not in_item[i + k] and not in_doc[j + k]
            if free and start is None:
                start = k
            elif not free and start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return out


def _item_seeds(items: DataFrame) -> DataFrame:
    """item, width and seed: runs of TILE words, or of all words if an item has fewer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(text_bytes(batch))
            n = np.minimum([len(words(t)) for t in texts], TILE)
            for width in np.unique(n[n > 0]).tolist():
                some = np.flatnonzero(n == width)
                ids = column(batch, "item").take(pa.array(some))
                for at, own in seeds([texts[i] for i in some], width):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), width, np.int32)), pa.array(own.view(np.int64))], ["item", "width", "seed"])

    return items.mapInArrow(each, "item long, width int, seed long")


def _seed_filter(seeds_: DataFrame) -> np.ndarray:
    """One bit for each value of the low FILTER_BITS of an item seed; partitions send packed bits, joined one by one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            low = column(batch, "seed").to_numpy() & ((1 << FILTER_BITS) - 1)
            np.bitwise_or.at(bits, low >> 3, np.left_shift(1, low & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(bits)])], ["bits"])

    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in seeds_.mapInArrow(each, "bits binary").toLocalIterator():
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(row.bits), np.uint8)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, mark (hash of the text), item_id, n_words (of the item), covered, coverage and tiles of every document
    and benchmark item whose tiles cover at least that share of the item's words, in whatever order they stand.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. Words are runs of ASCII letters
    and digits and characters beyond ASCII, A-Z lower-cased. An item of fewer than TILE words is found where all its
    words stand one after another. Items and documents without a word have nothing in common with anything. Repeated
    rows of docs give one result. A null doc_id is carried as null; a null item_id too. Empty tables give an empty
    result. A very long text is hashed in pieces and tiled as a whole, once for each item that it may hold.

    Seeds are runs of TILE words (of all words of a shorter item). A filter of fixed size (8 MB) lets through document
    seeds that an item may have; these are joined with the items' seeds, and only pairs whose seeds could reach the
    coverage are tiled. A filter too small for a huge benchmark only lets more seeds into the join. A seed that more than
    HOT documents hold is dealt to several tasks.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    item_seeds = materialise(_item_seeds(items.select("item", "text")).groupBy("seed", "width", "item").count(), "item-seeds")
    widths = sorted(r.width for r in item_seeds.select("width").distinct().collect())  # at most TILE
    bits = docs.sparkSession.sparkContext.broadcast(_seed_filter(item_seeds))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            held = list(text_bytes(batch))
            for width in widths:
                for at, own in seeds(held, width):
                    low = (own & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    hit = known[low >> 3] >> (low & 7).astype(np.uint8) & 1 > 0
                    pair = np.unique(np.stack([at[hit], own[hit].view(np.int64)]), axis=1)
                    some = batch.take(pa.array(pair[0]))
                    yield pa.RecordBatch.from_arrays([column(some, "doc_id"), column(some, "mark"), pa.array(np.full(len(pair[1]), width, np.int32)), pa.array(pair[1])], ["doc_id", "mark", "width", "seed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("mark", F.xxhash64("text"))
    held = materialise(texts.mapInArrow(hits, "doc_id long, mark long, width int, seed long").distinct(), "document-seeds")
    hot = materialise(held.groupBy("width", "seed").count().where(F.col("count") > HOT).select("width", "seed", F.ceil(F.col("count") / HOT).cast("int").alias("deal")), "hot-seeds")
    if hot.limit(1).count():  # few: each stands for many documents
        deal = F.coalesce("deal", F.lit(1))
        held = held.join(hot, ["width", "seed"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), deal).cast("int"))
        dealt = item_seeds.join(hot, ["width", "seed"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), deal - 1)))
        met = held.drop("deal").join(dealt.drop("deal"), ["width", "seed", "salt"])
    else:
        met = held.join(item_seeds, ["width", "seed"])
    sized = items.withColumn("n_words", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).select("item", "item_id", F.col("text").alias("item_text"), "n_words")
    # a seed covers its width at most
    pairs = met.groupBy("doc_id", "mark", "item").agg(F.sum(F.col("count") * F.col("width")).alias("covers")).join(sized.select("item", "n_words"), "item")
    pairs = materialise(pairs.where(F.col("covers") >= F.col("n_words") * coverage).select("doc_id", "mark", "item"), "tiling-pairs")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tiles(own := words(i), words(t), min(TILE, len(own))) for i, t in zip(text_bytes(batch, "item_text"), text_bytes(batch), strict=True)]
            covered = np.array([sum(n for _, _, n in f) for f in found], np.int64)
            names = ("doc_id", "mark", "item_id", "n_words")
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(covered), pa.array([len(f) for f in found], pa.int64())], [*names, "covered", "tiles"])

    same = (F.col("p.mark") == F.col("d.mark")) & F.col("p.doc_id").eqNullSafe(F.col("d.doc_id"))
    # Spark broadcasts the pairs if their files are small, and else deals both sides out
    both = pairs.alias("p").join(texts.alias("d"), same).select("d.doc_id", "d.mark", "d.text", "p.item").dropDuplicates(["doc_id", "mark", "item"])
    ready = both.join(sized, "item").select("doc_id", "mark", "item_id", F.col("n_words").cast("long").alias("n_words"), "text", "item_text")
    done = ready.mapInArrow(tile, "doc_id long, mark long, item_id long, n_words long, covered long, tiles long")
    return done.withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns, whatever their names. Null and empty texts hold
    none and stay; rows with equal doc_id and text share their fate; a very long text is tested as a whole; empty tables
    take nothing away."""
    rows = private(docs, "doc_id", "text")
    found = materialise(contamination(rows, benchmark, coverage).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct(), "contaminated")
    own = (F.xxhash64(F.col("text").cast("string")) == F.col("_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))
    return restored(rows.join(found, own, "left_anti"), docs, "doc_id", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_words", "covered", "coverage", "tiles")
