"""Runs against their definition, tried period by period."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import runs
from tests.llm.helpers import clashing, docs


def brute(words, least_words=24, least_periods=3):
    """Every maximal stretch that keeps a period and no smaller one."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= 2 * q and (at, length) not in found:  # a smaller period of this stretch came first
                found[at, length] = q
            at = end + 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least_words, least_periods * q))


def found(words, *least):
    return [tuple(r) for r in runs.find_runs(runs.numbered(words), *least).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab", max_size=60), st.text("abc", max_size=90)), st.integers(2, 8), st.integers(2, 3))
def test_small_alphabets(text, least_words, least_periods):
    assert found(list(text), least_words, least_periods) == brute(text, least_words, least_periods)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcdef", min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), max_size=7), st.integers(4, 24))
def test_repeated_parts(parts, least_words):
    text = "".join(part * times + part[:more] for part, times, more in parts)
    text += text[: len(text) // 2]
    assert found(list(text), least_words) == brute(text, least_words)


def test_known_words():
    strings = ["a", "ab"]
    while len(strings[-1]) < 400:
        strings.append(strings[-1] + strings[-2])  # Fibonacci's, with the most runs
    for text in (strings[-1], "ab" * 200, "a" * 300, "aab" * 70 + "aab" * 30, "".join(bin(k).count("1") % 2 and "1" or "0" for k in range(300))):
        for least in (2, 24):
            assert found(list(text), least, 2) == brute(text, least, 2)


def test_blocks_are_the_longest_with_an_earlier_start():
    text = "abaababaabaababaababa" * 3
    starts = runs.Suffixes(runs.numbered(list(text))).blocks().tolist()
    at = 0
    for start, end in zip(starts, [*starts[1:], len(text)], strict=True):
        assert start == at
        size = 0
        while start + size < len(text) and text.find(text[start : start + size + 1], 0, start + size) >= 0:
            size += 1
        assert end - start == max(size, 1)
        at = end


def test_long_texts():
    assert found(["w"] * 200_000) == [(0, 200_000, 1)]
    some = np.random.default_rng(1).integers(0, 900, 30_000).tolist()
    assert found(some + some[-9_000:] * 3) == [(21_000, 36_000, 9_000)]


def collapsed(words, those):
    gone = {k for s, n, q in those for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_rows_of_any_kind(spark):
    own = [(70, "  one two three " * 12 + "\n\tend\x0b", "en", "a", 1), (71, "a b " * 11, "en", "a", 1), (71, "a b " * 12, "en", "a", 1)]
    frame = clashing(docs(spark).union(docs(spark, own)))
    got = sorted((repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in runs.periodic_runs(frame).collect()))
    want = []
    for r in frame.collect():
        words = (r.text or "").encode().split()
        those = brute([w.decode() for w in words]) if len(words) < 1000 else [(0, len(words), 1)]
        want.append(repr((r.doc_id, len(words), those, collapsed([w.decode() for w in words], those))))
    assert got == sorted(want)
    assert runs.periodic_runs(docs(spark, [])).count() == 0


def test_query(spark, tmp_path):
    from heliograph.llm.common import table

    sf = "/root/testdata/sf0.001"
    some = table(spark, sf, "documents").where("length(text) < 6000 or text is null").union(table(spark, sf, "documents").limit(1).selectExpr("null", "text", "lang", "source", "n_chars"))
    some.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in table(spark, str(tmp_path), "documents").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        those = brute(words)
        best = min(those, key=lambda x: (-np.longdouble(x[1]) / x[2], x[0], x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(those), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in those)), sha(collapsed(words, those)))
    got = {r.doc_id: tuple(r)[1:] for r in runs.op13_runs(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 10
