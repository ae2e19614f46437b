import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from heliograph.llm import language as L
from tests.llm.helpers import clashing, docs, rows


def brute_model(texts):
    """Interpolated Kneser-Ney by dictionaries; returns a function from (history, symbol) to a probability."""
    counts = {n: Counter() for n in range(1, L.ORDER + 1)}
    for t in texts:
        s = [L._BEGIN] * (L.ORDER - 1) + L.symbols(t).tolist()
        for i in range(L.ORDER - 1, len(s)):
            counts[L.ORDER][tuple(s[i - L.ORDER + 1 : i + 1])] += 1
    for n in range(L.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones else 0.5

    total, kinds = {n: defaultdict(int) for n in counts}, {n: defaultdict(int) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(history, symbol, n=L.ORDER):
        if n == 0:
            return L.UNIFORM
        h = tuple(history)[len(history) - n + 1 :] if n > 1 else ()
        lower = p(history, symbol, n - 1)
        if not total[n][h]:
            return lower
        d = discount(n)
        return max(counts[n][h + (symbol,)] - d, 0) / total[n][h] + d * kinds[n][h] / total[n][h] * lower

    return p


def test_probabilities_equal_brute_force():
    own = {"x": ["abra cadabra", "a bad bar", "cab"], "y": ["zyx zyzzy", "bazaar é"]}
    models = L.Models({n: L.train([t.encode() for t in ts]) for n, ts in own.items()})
    texts = ["abracab", "zyzzy bar", "qé q"]
    entropy, size, _ = models.entropies([t.encode() for t in texts])
    for j, name in enumerate(models.names):
        p = brute_model([t.encode() for t in own[name]])
        for i, t in enumerate(texts):
            s = [L._BEGIN] * (L.ORDER - 1) + L.symbols(t.encode()).tolist()
            logs = [math.log(p(s[k - L.ORDER + 1 : k], s[k])) for k in range(L.ORDER - 1, len(s))]
            assert entropy[i, j] == pytest.approx(-sum(logs) / size[i], rel=1e-4)


def test_hash_arrays_find_all_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = L.Hashed(keys, keys.astype(np.float64))
    assert (table.values[table.find(keys)] == keys.astype(np.float64)).all()
    other = np.setdiff1d(rng.integers(0, 1 << 62, 5000, dtype=np.uint64), keys)
    assert (table.find(other) == -1).all()


def labelled():
    en = "the {} and of {} with which they were going to the other side of a river where it is"
    fr = "le {} et la {} avec les autres qui sont dans une maison où il était pour des raisons"
    data = []
    for i in range(160):
        text = (en if i % 2 else fr).format("word" * (i % 5), i) * (1 + i % 4)
        data.append((i, text, "en" if i % 2 else "fr", "s", 1))
    return data


def test_held_out_accuracy_and_odd_rows(spark):
    frame = docs(spark, labelled())
    models = L.fit(frame)
    got = L.identify(frame, models, carry=("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang and r.accepted for r in got)
    odd = L.identify(clashing(docs(spark)), models).collect()
    assert len(odd) == len(rows())
    for d, t, *_ in rows():
        mine = [r for r in odd if r.doc_id == d]
        if t is None or not any(c.isalpha() for c in t):
            assert any(r.lang_pred == "und" and r.score == 0 and not r.accepted for r in mine)
    noise = docs(spark, [(1, "xqzjk vvwqx 漢zzx qqj kxv" * 9, None, None, 1), (2, labelled()[11][1], None, None, 1)])
    assert {r.doc_id: r.accepted for r in L.identify(noise, models).collect()} == {1: False, 2: True}


def test_nothing_to_learn(spark):
    frame = docs(spark, [(1, "abc", None, "a", 1), (2, None, "en", "a", 1)])
    assert [r.lang_pred for r in L.identify(frame, L.fit(frame)).collect()] == ["und", "und"]
    assert L.identify(docs(spark, []), None).count() == 0


def test_small_languages_reject_too(spark):
    """With two texts to learn from, what is nothing like them is still rejected."""
    few = [(i, "the quick brown fox jumps over the lazy dog and runs away from here " * 6, "en", "s", 1) for i in range(3)]
    few += [(10 + i, "der schnelle braune fuchs springt über den faulen hund und läuft weg " * 6, "de", "s", 1) for i in range(3)]
    frame = docs(spark, few + [(100, "Ωμέγα ψυχή λόγος " * 30, None, "s", 1), (101, "the lazy dog runs over the quick fox", None, "s", 1)])
    got = {r.doc_id: r for r in L.identify(frame, L.fit(frame)).collect()}
    assert not got[100].accepted and got[101].accepted and got[101].lang_pred == "en"
    assert all(got[d].accepted for d, *_ in few)


def test_groups_of_languages_agree(spark, monkeypatch):
    texts = {f"l{k}": [f"{chr(97 + k)}{chr(98 + k)} word{chr(99 + k)} " * 9] for k in range(7)}
    own = {n: L.train([t.encode() for t in ts]) for n, ts in texts.items()}
    whole = L.Models(own).entropies([t.encode() for ts in texts.values() for t in ts])[0]
    monkeypatch.setattr(L, "SIDE_BY_SIDE", 2)
    assert np.allclose(L.Models(own).entropies([t.encode() for ts in texts.values() for t in ts])[0], whole)
