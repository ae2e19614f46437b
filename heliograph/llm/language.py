"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import column, materialise, table, text_bytes

ORDER = 4
#: Models are fitted on at most so many whole documents of each language, the first by a hash of doc_id, and on no more
#: of these than reach this many bytes; the one that reaches them counts.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 4 << 20
#: Languages whose models are looked up side by side: what all models take grows with their number, not its square.
SIDE_BY_SIDE = 16
#: Languages up to which their counts and the names of all sampled documents are sent to every task.
SENT_LANGUAGES = 1000
#: Symbols of the pieces on which a language with few held-back texts is calibrated.
PIECE = 200
#: One in so many of these is held back to calibrate the rejection.
CALIBRATE = 5
#: Standard deviations above the calibrated cross-entropy from which a text is rejected. The spread between texts
#: counts as SPREAD at least, so that texts in two known languages, or with few different words, are kept.
REJECT, SPREAD = 6.0, 0.15
#: Sharpness of the score; probability of a character that no model knows, within a model's own rest.
SHARP, UNIFORM = 8.0, 1e-3
UNDETERMINED = "und"
CHUNK = 1 << 19  # characters that are scored at once

_SPACE, _BEGIN = 32, 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _fold_table(size: int = 0x3000) -> np.ndarray:
    fold = np.full(size, _SPACE, np.uint16)
    for c in range(size):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            fold[c] = ord(low[0]) if ord(low[0]) < 0x10000 else c
    return fold


_FOLD = _fold_table()


def symbols(text: bytes | None) -> np.ndarray:
    """Lower-case letters of a text; every run of other characters is one space. 16 bits each."""
    points = np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32)
    high = points >= len(_FOLD)
    out = _FOLD[np.where(high, _SPACE, points)]
    if high.any():
        own, where = np.unique(points[high], return_inverse=True)
        fold = np.array([c if c < 0x10000 else 0xE000 + c % 0x1900 for c in own.tolist()], np.uint16)  # rare letters share codes
        out[high] = np.where(np.array([chr(c).isalpha() for c in own.tolist()])[where], fold[where], _SPACE)
    return out[~((out == _SPACE) & np.r_[True, out[:-1] == _SPACE])] if len(out) else out


def grams(sequence: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last `order` symbols up to each place, 16 bits each, the last one lowest. Starts are filled up."""
    padded = np.concatenate([np.full(order - 1, _BEGIN, np.uint16), sequence]).astype(np.uint64)
    out = padded[order - 1 :].copy()
    for back in range(1, order):
        out |= padded[order - 1 - back : len(padded) - back] << np.uint64(16 * back)
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def train(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """One language: for each order the n-grams with their interpolated probability, and the histories with the
    weight that they leave to the order below."""
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(grams(symbols(t)) for t in texts)]), return_counts=True)
    levels = [(keys, counts)]
    for order in range(ORDER - 1, 0, -1):  # below the highest, a count is the number of different symbols before
        levels.append(np.unique(levels[-1][0] & _mask(order), return_counts=True))
    model: dict[str, np.ndarray] = {}
    lower_keys, lower = np.zeros(1, np.uint64), np.array([UNIFORM])
    for order, (keys, counts) in enumerate(reversed(levels), 1):
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones else 0.5
        history = keys >> np.uint64(16)
        starts = np.flatnonzero(np.r_[True, history[1:] != history[:-1]]) if len(keys) else np.zeros(0, np.int64)
        total, kinds = (np.add.reduceat(x, starts) if len(keys) else counts for x in (counts, np.ones_like(counts)))
        rest = discount * kinds / total
        of = np.repeat(np.arange(len(starts)), kinds)
        below = lower[np.searchsorted(lower_keys, keys & _mask(order - 1))] if order > 1 else np.full(len(keys), UNIFORM)
        p = (counts - discount) / total[of] + rest[of] * below
        model |= {f"keys{order}": keys, f"p{order}": p, f"histories{order}": history[starts], f"rest{order}": rest}
        lower_keys, lower = keys, p
    return model


class Hashed:
    """A sorted hash array with a row of values for each entry; the top bits of a hash lead to its place.

    The hash of a key is its product with an odd number modulo 2^64, so different keys never collide.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys * _SPREAD
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.shift = np.uint64(64 - max(4, int(max(1, len(keys)) - 1).bit_length() + 2))
        bounds = np.arange((1 << int(64 - self.shift)) + 1, dtype=np.float64) * 2.0 ** float(self.shift)
        self.first = np.searchsorted(self.hashes, bounds[:-1].astype(np.uint64)).astype(np.int32)
        tops = (self.hashes >> self.shift).astype(np.int64)
        self.longest = int(np.bincount(tops).max()) if len(tops) else 0
        self.hashes = np.r_[self.hashes, np.full(self.longest + 1, 0, np.uint64)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        hashes = keys * _SPREAD
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        out = np.where(self.hashes[at] == hashes, at, -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.longest):
            hit = self.hashes[at[left] + step] == hashes[left]
            out[left[hit]] = at[left[hit]] + step
            left = left[~hit]
        return out


class Group:
    """Models of some languages side by side: one lookup serves them all."""

    def __init__(self, own: dict[str, dict[str, np.ndarray]]):
        self.names = sorted(own)
        self.levels: list[tuple[Hashed, Hashed]] = []
        below_keys, below = np.zeros(1, np.uint64), np.full((1, len(self.names)), UNIFORM)
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([own[n][f"keys{order}"] for n in self.names]))
            histories = np.unique(np.concatenate([own[n][f"histories{order}"] for n in self.names]))
            rest = np.ones((len(histories), len(self.names)))
            p = np.zeros((len(keys), len(self.names)))
            for i, n in enumerate(self.names):
                rest[np.searchsorted(histories, own[n][f"histories{order}"]), i] = own[n][f"rest{order}"]
                p[np.searchsorted(keys, own[n][f"keys{order}"]), i] = own[n][f"p{order}"]
            lower = below[np.searchsorted(below_keys, keys & _mask(order - 1))] if order > 1 else np.full_like(p, UNIFORM)
            p = np.where(p > 0, p, rest[np.searchsorted(histories, keys >> np.uint64(16))] * lower)
            self.levels.append((Hashed(keys, np.log(p).astype(np.float32)), Hashed(histories, np.log(rest).astype(np.float32))))
            below_keys, below = keys, p

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last symbol under every language."""
        out = np.full((len(keys), len(self.names)), np.log(UNIFORM), np.float32)
        open_ = np.arange(len(keys))
        weight = None
        for order in range(ORDER, 0, -1):
            table_, histories = self.levels[order - 1]
            own = keys[open_] & _mask(order)
            at = table_.find(own)
            hit = at >= 0
            found = table_.values[at[hit]]
            out[open_[hit]] = found if weight is None else found + weight[hit]
            if hit.all():
                return out
            miss = ~hit
            back = histories.find(own[miss] >> np.uint64(16))
            left = np.where((back >= 0)[:, None], histories.values[back], np.float32(0))
            weight = left if weight is None else weight[miss] + left
            open_ = open_[miss]
        out[open_] = weight + np.float32(np.log(UNIFORM))
        return out


class Models:
    """Models of all languages, SIDE_BY_SIDE in a group."""

    def __init__(self, own: dict[str, dict[str, np.ndarray]], limits: dict[str, tuple[float, float, float]] | None = None):
        self.names = sorted(own)
        self.limits = limits or {}
        self.groups = [Group({n: own[n] for n in self.names[at : at + SIDE_BY_SIDE]}) for at in range(0, len(self.names), SIDE_BY_SIDE)]

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last symbol under every language."""
        return self.groups[0].logs(keys) if len(self.groups) == 1 else np.concatenate([g.logs(keys) for g in self.groups], axis=1)

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean negative log probability of each text's symbols under every language, their number, letters' number."""
        total = np.zeros((len(texts), len(self.names)))
        size, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        whose: list[int] = []
        room = 0

        def score() -> None:
            lengths = np.array([len(k) for k in held])
            logs = self.logs(np.concatenate(held))
            sums = np.add.reduceat(logs, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
            np.add.at(total, whose, -sums)
            held.clear()
            whose.clear()

        for i, text in enumerate(texts):
            sequence = symbols(text)
            size[i], letters[i] = len(sequence), (sequence != _SPACE).sum()
            if not letters[i]:
                continue
            keys = grams(sequence)
            for at in range(0, len(keys), CHUNK):
                held.append(keys[at : at + CHUNK])
                whose.append(i)
                room += len(held[-1])
                if room >= CHUNK:
                    score()
                    room = 0
        if held:
            score()
        return total / np.maximum(size, 1)[:, None], size, letters

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is accepted."""
        entropy, size, letters = self.entropies(texts)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-SHARP * (entropy - least[:, None])).sum(1)
        limit = np.array([self.limits.get(n, (np.inf, 0.0, 0.0)) for n in self.names])[best]
        accepted = least <= limit[:, 0] + REJECT * (np.maximum(limit[:, 1], SPREAD) + limit[:, 2] / np.sqrt(np.maximum(size, 1)))
        none = letters == 0
        names = [UNDETERMINED if n else self.names[b] for n, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, np.nan, least), accepted & ~none


def calibrate(models: Models, name: str, texts: list[bytes | None], others: list[bytes | None] = ()) -> tuple[float, float, float]:
    """Mean cross-entropy of a language's own held-back texts, its spread between texts, and within them.

    With fewer than five such texts, pieces of them count, and with fewer than five pieces those of the other texts, too;
    the spread between texts then is at least SPREAD like that of any language. A language without a letter rejects
    all, as nothing is ever nearest to it."""
    entropy, size, letters = models.entropies(texts)
    if (letters > 0).sum() < 5:
        cut = lambda some: [p for t in some for line in [(t or b"").decode()] for p in (line[i : i + PIECE].encode() for i in range(0, len(line), PIECE))]
        pieces = cut(texts)
        if sum(bool((symbols(p) != _SPACE).any()) for p in pieces) < 5:
            pieces += cut(others)
        texts = pieces
        entropy, size, letters = models.entropies(texts)
    own = entropy[letters > 0, models.names.index(name)]
    if not len(own):
        return 0.0, 0.0, 0.0
    some = texts[: min(len(texts), 50)]
    logs = models.logs(np.concatenate([grams(symbols(t)) for t in some]))[:, models.names.index(name)]
    weight = size[letters > 0]
    mean = float((own * weight).sum() / weight.sum())
    long = own[weight >= 200]
    return mean, float(long.std()) if len(long) > 4 else float(own.std()), float(logs.std())


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: CRC-32 of doc_id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> Models | None:
    """Models of all languages that documents outside the held-out fifth are labelled with; None without any.

    At most SAMPLE_DOCS whole texts of each language, of SAMPLE_BYTES in all, are used, chosen by a hash of doc_id on a
    table without texts. Languages are counted first, and only documents whose hash is in the lowest part that holds some
    four times SAMPLE_DOCS are ranked, so that a language with most of the rows isn't ranked in one task; equal rows count
    once, and texts that share a doc_id are told apart by their hash, so that the bound holds for them, too. A null doc_id
    is held out, as an empty string is. Each language is counted in one task, and the driver only gets the arrays.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    slim = labelled.select("doc_id", "lang", F.octet_length("text").alias("n_bytes"), F.xxhash64(F.col("doc_id")).alias("place"), F.xxhash64("text").alias("tie"))
    counted = materialise(slim.groupBy("lang").agg(F.count("*").alias("n_docs")), "languages")
    few = counted.count() <= SENT_LANGUAGES  # else all is joined
    sent = F.broadcast if few else lambda df: df
    low = (F.shiftrightunsigned("place", 11) / float(1 << 53)) * F.col("n_docs") < 4 * SAMPLE_DOCS
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "tie")
    before = F.coalesce(F.sum("n_bytes").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # equal rows are one
    chosen = slim.join(sent(counted), "lang").where(low).dropDuplicates(["lang", "doc_id", "tie"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS).withColumn("before", before).where(F.col("before") < SAMPLE_BYTES)
    keys = ["doc_id", "lang", "tie"]
    texts = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("tie"))
    # SAMPLE_DOCS rows for each language at most
    sample = texts.join(sent(chosen.select(*keys, "n")), keys).dropDuplicates(keys)

    def own(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["n"].to_numpy())
        texts = [t.as_py().encode() for t in rows["text"].combine_chunks().take(pa.array(order))]
        back = [t for i, t in enumerate(texts) if i % CALIBRATE == 0]
        used = [t for i, t in enumerate(texts) if i % CALIBRATE] or back
        if not any((symbols(t) != _SPACE).any() for t in used):
            used = [b" "]  # nothing to learn, yet a label
        name = rows["lang"][0].as_py()
        model = train(used)
        limits = calibrate(Models({name: model}), name, back, used)
        np.savez(out := io.BytesIO(), limits=np.array(limits), **model)
        return pa.table({"lang": [name], "model": pa.array([out.getvalue()], pa.binary())})

    models, limits = {}, {}
    for row in sample.groupBy("lang").applyInArrow(own, "lang string, model binary").collect():  # a row for each language
        arrays = dict(np.load(io.BytesIO(row.model)))
        limits[row.lang] = tuple(arrays.pop("limits").tolist())
        models[row.lang] = arrays
    return Models(models, limits) if models else None


def identify(docs: DataFrame, models: Models | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, lang_pred, score, cross_entropy and accepted of every whole text.

    Looks only at text. A null text or one without a letter is ``und``, with score 0, no cross-entropy and not
    accepted; so is everything, with `und`, if there is no model, as then there is no learned value to tell. A very long text
    is scored in pieces and as a whole. An empty table gives an empty result. Other texts get the language with the lowest cross-entropy for
    each symbol; they are accepted unless it is far above what that language's held-back texts had. Repeated rows
    each give a row; extra columns stay if carried. No exchange.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # n-grams of the bounded sample

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = list(text_bytes(batch, "_text"))
            if model:
                names, score, entropy, accepted = model.predict(texts)
            else:
                names, score, entropy, accepted = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            entropy = pa.array(entropy, mask=np.isnan(entropy))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in carry), pa.array(names), pa.array(score), entropy, pa.array(accepted)], [*carry, "lang_pred", "score", "cross_entropy", "accepted"])

    kept = docs.select(*(f"`{c}`" for c in carry), F.col("text").cast("string").alias("_text"))
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInArrow(each, f"{form}, lang_pred string, score double, cross_entropy double, accepted boolean")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
