import hashlib

import numpy as np
import pytest

from heliograph.llm import repeats


def brute(docs):
    """Removal by definition; docs: (doc_id, text), equal ids cost each other nothing."""
    least, out = {}, []
    for doc, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            least[w] = min(least.get(w, float("inf")), float("inf") if doc is None else doc)
    for doc, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 49):
            if least[data[p : p + 50]] < (float("inf") if doc is None else doc):
                gone[p] += 1
                gone[p + 50] -= 1
        gone = np.cumsum(gone)[: len(data)] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    sounds = np.array(["th", "er", "on", " ", "a", "é", ". ", "tion", "re"])
    prose = lambda k: "".join(rng.choice(sounds, k))
    shared = [prose(int(rng.integers(20, 80))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [prose(int(rng.integers(1, 60)))]
        for s in rng.choice(6, rng.integers(0, 4)):
            text = shared[s]
            a, b = sorted(rng.integers(0, len(text), 2))
            parts += [text if rng.random() < 0.5 else text[a:b], prose(int(rng.integers(0, 30)))]
        texts.append("".join(parts))
    texts[5] = texts[40] = texts[2]  # copies
    texts[7] = texts[3] + texts[4] + texts[3]
    texts[9] = "a" * 400
    texts[11] = "xy" + "a" * 300
    texts[13], texts[14] = "", None
    ids = rng.permutation(n * 3)[:n].tolist()
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:5] for r in repeats.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_equal_and_null_ids_and_extra_columns(spark):
    docs = [(1, "a b c " * 30), (1, "a b c " * 30), (1, "b c a " * 40), (None, "c a b " * 30), (None, "zz" * 40), (7, "zz" * 45)]
    frame = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, key int, kind string")
    got = [tuple(r)[:5] for r in repeats.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    docs = corpus(4)
    docs.append((1000, "".join(t or "" for _, t in docs) * 3))
    monkeypatch.setattr(repeats, "CHUNK", 1 << 11)
    first, windows = {}, {}
    for doc, text in docs:
        for chunk in repeats.pieces([(doc, 0, (text or "").encode())]):
            for key, _, d, p in zip(*repeats.anchors(chunk), strict=True):
                first.setdefault(int(key), set()).add((int(d), int(p)))
    for doc, text in docs:  # every window holds an anchor, at the same place as in its equals
        places = sorted(p for s in first.values() for d, p in s if d == doc)
        for start in range(len((text or "").encode()) - 49):
            near = [p for p in places if start <= p <= start + repeats.SLIDE]
            assert near
            windows.setdefault((text or "").encode()[start : start + 50], set()).add(tuple(p - start for p in near))
    assert all(set.intersection(*map(set, offsets)) for offsets in windows.values())


def test_many_texts_without_an_id(spark):
    """Thousands of texts with one doc_id or none, some of which repeat a passage of document 1 and of each other."""
    rng = np.random.default_rng(8)
    prose = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, int(rng.integers(60, 220))))
    passage = prose() + prose()
    docs = [(1, passage[:91])] + [((None, 7)[k % 5 == 0], prose() + (passage[: 80 + k % 60] if k % 9 == 0 else "")) for k in range(6000)]
    docs += [(9, passage), (None, docs[77][1]), (5, docs[78][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:5] for r in repeats.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_one_row_many_times(spark):
    docs = [(3, "the same row again and again, " * 5)] * 10_000 + [(None, "no id " * 20)] * 500 + [(4, "x" * 60 + "the same row again and again, " * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [tuple(r)[:5] for r in repeats.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
