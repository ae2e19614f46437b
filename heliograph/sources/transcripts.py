"""Text by models: cleaning transcripts, spoken file names, and chunking by a token budget."""

from __future__ import annotations

import difflib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.text import spoken_key

# Fixed values.
FILLERS = frozenset(("you", "thank you", "thanks", "thanks for watching", "thank you for watching", "thank you very much", "please subscribe", "bye", "bye bye", "so", "oh", "okay", "uh", "um", "hmm", "music", "applause", "laughter"))
LONGEST_PHRASE, WORD_RUNS, PHRASE_RUNS = 8, 4, 3
JUDGED_WORDS, LOOPED_SHARE, JUDGED_CHARS, LOOPED_RATIO = 12, 0.5, 120, 8.0
CLOSE_LETTERS, SAME_LETTERS, CLOSE_SOUND, SAME_SOUND, REST_SOUND, MARGIN = 0.5, 0.9, 0.8, 0.9, 0.75, 0.05
SHORTEST_NAME = 4

_ASIDE = re.compile(r"\[[^\]]*\]|\([^)]*\)|[♪♫]+")


def _said(text: str) -> str:
    return re.sub(r"[^a-z0-9']+", " ", text.lower()).strip()


def loops(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest loop that begins there and its period; 0 where none does.

    For a period p, a stretch in which every word equals the one p places on is a loop as long as the stretch and p
    more; whole rounds count. Of loops of equal length the shortest period stands.
    """
    n = len(codes)
    length, period = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for p in range(min(LONGEST_PHRASE, n - 1), 0, -1):
        same = np.zeros(n, bool)
        same[: n - p] = codes[p:] == codes[:-p]
        stops = np.flatnonzero(~same)
        stretch = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        rounds = stretch // p + 1
        whole = np.where(rounds >= (WORD_RUNS if p == 1 else PHRASE_RUNS), rounds * p, 0)
        better = (whole > 0) & (whole >= length)
        length[better], period[better] = whole[better], p
    return length, period


def without_loops(text: str) -> str:
    """One round of each phrase of up to eight words that is said again and again; words of what stays are untouched."""
    words = text.split()
    if not words:
        return ""
    codes = np.unique([_said(w).replace(" ", "") for w in words], return_inverse=True)[1]
    length, period = loops(codes)
    keep = np.ones(len(words), bool)
    at = 0
    for start in np.flatnonzero(length).tolist():
        if start >= at:
            at = start + int(length[start])
            keep[start + int(period[start]) : at] = False
    return " ".join(np.array(words, object)[keep])


def looped(text: str, kept: str) -> bool:
    """Whether a window says little but the same: enough words to judge, and half of them gone or hardly any new bytes."""
    n = len(text.split())
    if n < JUDGED_WORDS:
        return False
    raw = text.encode()
    return n - len(kept.split()) >= LOOPED_SHARE * n or (len(text) >= JUDGED_CHARS and len(raw) > LOOPED_RATIO * len(zlib.compress(raw)))


def window_text(text: str | None, of_file: bool = True) -> str:
    """What a window says, without captions and loops; nothing if it is a loop or, in a file, only filler."""
    bare = _ASIDE.sub(" ", text or "").strip()
    kept = without_loops(bare)
    idle = not kept or looped(bare, kept) or (of_file and _said(kept) in FILLERS)
    return "" if idle else kept


def transcripts(windows: DataFrame) -> DataFrame:
    """file_id and text of windows (file_id, start, text): windows cleaned, joined in order, and once more without loops,
    as windows that each looked fine can repeat one another. A file with nothing left has an empty text."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(window_text)

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(without_loops)

    own = windows.select("file_id", "start", F.pandas_udf(clean, "string")("text").alias("said")).where("said <> ''")
    joined = own.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "said"))), lambda w: w["said"]), " ").alias("said"))
    out = windows.select("file_id").distinct().join(joined, "file_id", "left")
    return out.select("file_id", F.pandas_udf(whole, "string")(F.coalesce("said", F.lit(""))).alias("text"))


# -- spoken names ----------------------------------------------------------------------------------------------------


def _alike(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def likeness(heard: list[str], name: list[str], known: frozenset[str] = frozenset()) -> float:
    """How likely these words are a name misheard, 0 if they aren't: letters that nearly agree, or letters that agree
    half and sounds that nearly do (a name of one word needs more). What differs must sound alike by itself, and must not
    be words of other names."""
    said, meant = "".join(heard), "".join(name)
    if heard == name or 10 * len(said) < 6 * len(meant):
        return 0.0
    rest, missing = [w for w in heard if w not in name], [w for w in name if w not in heard]
    if not rest or not missing or all(w in known for w in rest):
        return 0.0
    sound, wanted = spoken_key("".join(rest)), spoken_key("".join(missing))
    if sound != wanted and (len("".join(rest)) < 4 or _alike(sound, wanted) < REST_SOUND):
        return 0.0
    letters = _alike(said, meant)
    if letters >= SAME_LETTERS:
        return letters
    sounds = _alike(spoken_key(said), spoken_key(meant))
    return (letters + sounds) / 2 if letters >= CLOSE_LETTERS and sounds >= (SAME_SOUND if len(name) == 1 else CLOSE_SOUND) else 0.0


def snapped(utterance: str, names: list[str]) -> str:
    """The utterance with the words that must be a name replaced by it; as it was if none or several names fit.

    Only windows of at least half the utterance count, one word shorter to two longer than the name.
    """
    words = re.findall(r"[^\W_]+", utterance)
    heard = [w.lower() for w in words]
    split = {n: [w.lower() for w in re.findall(r"[^\W_]+", n)] for n in names}
    known = frozenset(w for own in split.values() for w in own)
    best: dict[str, tuple[float, int, int]] = {}
    for name, own in split.items():
        if len("".join(own)) < SHORTEST_NAME:
            continue
        spans = [(i, i + n) for n in range(max(1, len(own) - 1, -(-len(heard) // 2)), len(own) + 3) for i in range(len(heard) - n + 1)]
        score, start, end = max(((likeness(heard[i:j], own, known), -i, -j) for i, j in spans), default=(0.0, 0, 0))
        if score:
            best[name] = score, -start, -end
    if not best:
        return utterance
    first, *others = sorted(best, key=lambda n: -best[n][0])
    score, start, end = best[first]
    if others and score - best[others[0]][0] < MARGIN:
        return utterance
    return " ".join([*words[:start], first, *words[end:]])


def snap(utterances: DataFrame, names: DataFrame, most: int = 100_000) -> DataFrame:
    """utterances (query_id, query) with snapped. names: name, of a user's files; at most `most`, as each task holds them.

    Letter ratios have no key to join on, so every utterance meets every name, in the tasks of the utterances."""
    own = sorted(r.name for r in names.select("name").distinct().limit(most + 1).collect() if r.name)
    if len(own) > most:
        raise ValueError(f"more than {most} names")

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: snapped(t or "", own))

    return utterances.withColumn("snapped", F.pandas_udf(each, "string")("query"))


def token_chunks(docs: DataFrame, cost: Callable[[str], int], budget: int = 224, overlap: int = 32) -> DataFrame:
    """doc_id, chunk_index, start_offset, end_offset: windows of whole words whose tokens fit the budget. A word that
    is too long has a chunk of its own; a window begins far enough back to repeat `overlap` tokens, at least one word
    on. Sequential in a document, so a pandas function over whole documents."""

    def windows(text: str) -> Iterator[tuple[int, int]]:
        words = [(m.start(), m.end(), cost(m[0])) for m in re.finditer(r"\S+", text or "")]
        i = 0
        while i < len(words):
            end, used = i + 1, words[i][2]
            while end < len(words) and used + words[end][2] <= budget:
                used += words[end][2]
                end += 1
            yield words[i][0], words[end - 1][1]
            if end == len(words):
                return
            again, i_next = 0, end
            while i_next - 1 > i and again + words[i_next - 1][2] <= overlap:
                i_next -= 1
                again += words[i_next][2]
            i = i_next

    def each(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = [(d, k, s, e) for d, t in zip(page["doc_id"], page["text"], strict=True) for k, (s, e) in enumerate(windows(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_offset", "end_offset"])

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, chunk_index int, start_offset long, end_offset long")
