import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import decontaminate as D
from tests.llm.helpers import clashing, docs, rows


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: mark a longest common unmarked run until none is long enough."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(n)
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=20))
def test_tiles_are_greedy(a, b):
    got = D.tiles(a, b, 2)
    assert max([n for *_, n in got], default=0) == max(brute_tiles(a, b, 2), default=0)
    assert all(a[i : i + n] == b[j : j + n] and n >= 2 for i, j, n in got)
    used = [k for i, _, n in got for k in range(i, i + n)]
    assert len(used) == len(set(used))
    left_a, left_b = [None if k in set(used) else x for k, x in enumerate(a)], list(b)
    for _, j, n in got:
        left_b[j : j + n] = [-1] * n
    assert not brute_tiles([(k, "x") if x is None else x for k, x in enumerate(left_a)], left_b, 2)  # nothing is left


def test_reordered_passages_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(20, "too short"), (21, None), (22, "")]
    fill = lambda n: " ".join(word() for _ in range(n))
    w = items[3][1].split()
    data = [
        (1, f"{fill(50)} {items[0][1]} {fill(50)}"),
        (2, f"{fill(20)} {items[1][1].upper().replace(' ', ', ')}."),
        (3, f"{fill(5)} {' '.join(w[15:])} {fill(9)} {' '.join(w[:15])}"),
        (4, f"{fill(40)} {' '.join(items[4][1].split()[:12])} {fill(40)}"),  # two fifths of an item
        (5, fill(3000)),
        (6, "too short"),
        (7, f'{fill(9)} Too, SHORT {fill(9)}'),
        (8, 'too very short'),
    ] + [(100 + i, f"{items[7][1]} {fill(3)}") for i in range(40)]
    frame = docs(spark, [(d, t, "en", "s", 1) for d, t in data] + rows())
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.tiles) for r in D.contamination(clashing(frame), bench.selectExpr("*", "1 as item", "2 as seed")).collect()}
    assert got == {(1, 0): (1.0, 1), (2, 1): (1.0, 1), (3, 3): (1.0, 2), (6, 20): (1.0, 1), (7, 20): (1.0, 1)} | {(100 + i, 7): (1.0, 1) for i in range(40)}
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(data) + len(rows()) - 45


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.contamination(docs(spark, []), bench).count() == 0
    assert D.contamination(docs(spark), bench.where("false")).count() == 0
    assert D.clean(docs(spark), bench.where("false")).count() == len(rows())


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000)).encode()
    whole = sorted(h for _, own in D.seeds([text, b"", None]) for h in own.tolist())
    monkeypatch.setattr(D, "CHUNK", 1 << 11)
    assert sorted(h for _, own in D.seeds([text, b"", None]) for h in own.tolist()) == whole
    assert len(whole) == 5000 - D.TILE + 1


def test_equals_brute_force_over_all_pairs(spark, monkeypatch):
    """Every document is tiled with every item; seeds, filter, hot seeds and pruning lose nothing and add nothing."""
    monkeypatch.setattr(D, "HOT", 7)
    rng = random.Random(8)
    word = lambda: rng.choice("ash beech cedar date elm fir gum hazel ivy".split())
    line = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(line(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 20])))) for i in range(40)]
    data = []
    for d in range(120):
        own = line(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, len(w))
            own += rng.choice([w, w[cut:] + w[:cut], w[:cut], w[cut:] + line(2) + w[:cut]]) + line(rng.randint(0, 5))
        data.append((d, " ".join(own), "en", "s", 1))
    got = {(r.doc_id, r.item_id): r.covered for r in D.contamination(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for d, text, *_ in data:
        for i, item in items:
            own = D.words(item.encode())
            covered = sum(n for *_, n in D.tiles(own, D.words(text.encode()), min(D.TILE, len(own))))
            if covered >= D.COVERAGE * len(own):
                expected[d, i] = covered
    assert got == expected and len(expected) > 100


def test_short_items_stand_as_a_whole():
    assert D.tiles(D.words(b"a b"), D.words(b"a b a b"), 5) == []
    assert D.tiles(D.words(b"a b"), D.words(b"x a b"), 2) == [(0, 1, 2)]
    assert pytest.approx(D.COVERAGE) == 0.6
