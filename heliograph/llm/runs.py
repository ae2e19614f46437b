"""Periodic runs of words, by the linear-time method for tandem repeats: Lempel-Ziv blocks, suffix links, occurrences.

1. Suffixes are sorted by doubling. The names of all stretches of 2^j words that this gives on the way tell in a few
   comparisons how far any two places agree, forwards and backwards.
2. The text is cut into Lempel-Ziv blocks, each the longest that also starts earlier. The leftmost occurrence of any
   square (a stretch said twice in a row) crosses the border of two blocks, and its period is no longer than both
   together; so these periods are tried at each border. That gives the first square of each run there: a covering set.
3. From the locus of a square in the suffix tree, the suffix link and one word more lead to the next one, the square's
   rotation. These walks, each as long as its run, complete the vocabulary of squares; equal loci are visited once.
4. The leaves below each locus are the square's occurrences. Those next to each other merge into the runs.

Squares of a root that is itself periodic are left out in step 2, so a run is found by its smallest period only, and the
occurrences are no more than n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import table, text_bytes

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words by equal numbers from 0."""
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number)), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _names(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For j = 0, 1, ...: names of the stretches of 2^j words from each place on, in their order, up to the j where all
    differ. What would pass the end differs from all else. One more entry stands for the end."""
    n = len(codes)
    names, reach = np.append(np.unique(codes, return_inverse=True)[1], -1), 1
    yield names
    while names[:n].max(initial=0) + 1 < n:
        after = np.full(n, -1)
        after[: n - reach] = names[reach:n]
        names, reach = np.append(np.unique(names[:n] * (n + 1) + after + 1, return_inverse=True)[1], -1), 2 * reach
        yield names


def says_twice(codes: np.ndarray, width: int) -> bool:
    """Whether any stretch of 2^j words, the longest with up to `width`, stands at two places."""
    for j, names in enumerate(_names(codes)):
        if names[:-1].max(initial=0) + 1 == len(codes):
            return False
        if 2 << j > width:
            return True
    return False


class Suffixes:
    """The suffix tree of a word sequence, as sorted suffixes."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.names = [names.astype(np.int32) for names in _names(codes)]
        self.rank = self.names[-1][:n]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        #: Words that a sorted suffix shares with the one before it.
        self.shared = np.zeros(n, np.int32)
        self.shared[1:] = self.ahead(self.order[:-1], self.order[1:])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from two different places on are the same."""
        a, b = a.copy(), b.copy()
        size = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.names) - 1)):
            step = (self.names[j][a] == self.names[j][b]).astype(np.int64) << j
            for x in (a, b, size):
                x += step
        return size

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before two different places are the same."""
        a, b = a.copy(), b.copy()
        size = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.names) - 1)):
            inside = np.minimum(a, b) >= 1 << j
            step = (inside & (self.names[j][a - (1 << j)] == self.names[j][b - (1 << j)])).astype(np.int64) << j
            a -= step
            b -= step
            size += step
        return size

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks; overlapping what they repeat is allowed."""
        low, high, open_ = [-1] * self.n, [-1] * self.n, [-1]
        for at in self.order.tolist():  # the nearest suffixes in the order on either side that start earlier
            while open_[-1] > at:
                high[open_.pop()] = at
            low[at] = open_[-1]
            open_.append(at)
        places, longest = np.arange(self.n), np.zeros(self.n, np.int64)
        for earlier in (np.array(low), np.array(high)):
            there = earlier >= 0
            longest[there] = np.maximum(longest[there], self.ahead(places[there], earlier[there]))
        starts, at, steps = [], 0, np.maximum(longest, 1).tolist()
        while at < self.n:
            starts.append(at)
            at += steps[at]
        return np.array(starts)

    def covering(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of the runs that cross a border of blocks; their first squares cover the
        leftmost occurrences of all squares."""
        cuts = np.append(self.blocks(), self.n)
        tries = cuts[2:] - cuts[:-2]
        border = np.repeat(cuts[1:-1], tries)
        period = np.arange(len(border)) - np.repeat(np.cumsum(tries) - tries, tries) + 1
        word, found = self.names[0], []
        for shift in (0, 1):  # the border's place against the one a period on, or a period before
            a = border - shift * period
            b = a + period
            may = (a >= 0) & (b <= self.n)
            a, b, own = a[may], b[may], period[may]
            may = (word[a] == word[b]) | (a > 0) & (word[a - 1] == word[b - 1])
            a, b, own = a[may], b[may], own[may]
            on, back = self.ahead(a, b), self.behind(a, b)
            square = on + back >= own
            found.append(np.stack([a - back, b + on, own])[:, square])
        start, end, period = np.concatenate(found, axis=1)
        by = np.lexsort((period, end, start))
        start, end, period = start[by], end[by], period[by]
        first = np.ones(len(start), bool)  # one stretch by several periods: the others are multiples of the smallest
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return start[first], end[first], period[first]

    def locus(self, places: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last sorted suffix that begins with the `depth` words from each place on."""
        if not hasattr(self, "_least"):
            self._least = [self.shared]  # of 2^j neighbours each
            while 2 << len(self._least) - 1 < self.n:
                last, reach = self._least[-1], 1 << len(self._least) - 1
                self._least.append(np.minimum(last[:-reach], last[reach:]))
        first, last = self.rank[places].astype(np.int64), self.rank[places].astype(np.int64)
        for j in reversed(range(len(self._least))):
            least, step = self._least[j], 1 << j
            down = first - step + 1
            first -= step * ((down >= 1) & (least[np.clip(down, 0, len(least) - 1)] >= depth))
            last += step * ((last + step < self.n) & (least[np.clip(last + 1, 0, len(least) - 1)] >= depth))
        return first, last

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and smallest period of all runs of two periods or more."""
        start, end, period = self.covering()
        walk = end - start - 2 * period + 1  # squares of each run, by suffix links from the first
        places = np.repeat(start, walk) + np.arange(walk.sum()) - np.repeat(np.cumsum(walk) - walk, walk)
        period = np.repeat(period, walk)
        first, last = self.locus(places, 2 * period)
        once = np.unique(period * self.n + first, return_index=True)[1]
        first, period, many = first[once], period[once], (last - first + 1)[once]
        leaves = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.sort(np.repeat(period, many) * (2 * self.n + 1) + self.order[leaves])
        new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        if not len(at):
            return at, at, at
        final = np.append(new[1:], len(at)) - 1
        period, start = np.divmod(at[new], 2 * self.n + 1)
        return start, at[final] - at[new] + 2 * period, period


def find_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period), by start, then period. A run of n words and k periods or more says n - n / k words
    again; where no stretch of so many words stands twice there is none, and the tree isn't built."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < least_words or not says_twice(codes, least_words - least_words // least_periods):
        return none
    found = np.stack(Suffixes(codes).runs(), axis=1)
    found = found[found[:, 1] >= np.maximum(least_words, least_periods * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length and smallest period in words, by start, then period) and `collapsed`: the text
    without what a run says again after its first period, words joined by one space.

    Takes doc_id and text; other columns are ignored. Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch that keeps its
    smallest period, which no neighbouring word goes on with, and which has least_words words and least_periods (2 or
    more) periods. A null text is as an empty one: no words, no runs, an empty text. Repeated rows and equal or null
    doc_ids each give a row; an empty table gives an empty result. A very long text takes memory in proportion to its
    words and the logarithm of its longest repeat. No exchange: each text is searched where it is read.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts, runs, said = [], [], []
            for text in text_bytes(batch):
                words = (text or b"").split()  # ASCII white space is what parts words
                found = find_runs(numbered(words), least_words, least_periods)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                if len(found):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, found[:, 0] + found[:, 2], 1)
                    np.add.at(change, found[:, 0] + found[:, 1], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                said.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(said, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, OUT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every document whose crc32(doc_id) ends with the digit 0 goes on periodically from some word.

    A null doc_id counts as an empty string, whose CRC-32 is 0."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g, n = F.floor(h / 10).cast("long"), F.size(words)
    at = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - at) / period).cast("int")
    again: Column = F.slice(F.flatten(F.array_repeat(F.slice(words, at + 1, period), times)), F.lit(1), n - at)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), at), again), " ")
    return docs.select(F.col("doc_id").cast("long"), F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    one, other = (lambda x, y: x["length"] * y["period"]), (lambda x, y: y["length"] * x["period"])
    best = F.get(F.array_sort("runs", lambda x, y: F.when(one(x, y) > other(x, y), -1).when(one(x, y) < other(x, y), 1).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
