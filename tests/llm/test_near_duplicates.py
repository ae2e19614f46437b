import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from heliograph.llm import components, golay, nearcopies, simhash
from tests.llm.helpers import clashing, docs, rows


def brute_fingerprint(text, width):
    w = [x for x in "".join(c.lower() if c < "\x80" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
    shingles = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, most):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[top(i)] = top(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(len(ids))]


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    one, two = 1 << rng.integers(0, 23, 3000), 1 << rng.integers(0, 23, 3000)
    near, other = golay.near(words), golay.near(words ^ one ^ two)
    for a, b, w in zip(near, other, words, strict=True):
        assert set(a[a >= 0]) & set(b[b >= 0])  # words within two bits share an index
        assert len(set(a[a >= 0])) in (1, 6)
    codeword = words ^ golay.tables()[1][golay.syndromes(words)]
    assert (np.bitwise_count(codeword ^ words) <= 3).all() and (golay.syndromes(codeword) == 0).all()


def test_fingerprints_equal_brute_force():
    for _, text, *_ in rows():
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text, 3)


def test_links_keep_all_components(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(60):  # clouds of fingerprints a few bits apart, and one large dense cloud
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
    base = rng.getrandbits(64)
    prints += [base ^ sum(1 << b for b in range(14) if rng.random() < 0.3) for _ in range(600)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    class_of = dict(components.components(found.selectExpr("a", "b")).collect())
    got = {}
    for i, p in enumerate(signed):
        got.setdefault(class_of.get(p, p), set()).add(i)
    expected = {}
    for i, c in enumerate(classes(list(range(len(prints))), prints, 3)):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    base = random.Random(9).getrandbits(60)
    prints = sorted({base ^ sum(1 << b for b in range(9) if i >> b & 1) for i in range(400)})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert set(r[1] for r in components.components(found).collect()) == {prints[0]}


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(clashing(docs(spark)))
    data = rows()
    prints = [brute_fingerprint(t, 3) for _, t, *_ in data]
    expected = classes([d for d, *_ in data], prints, 3)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got.collect()) == sorted((str(d), p, str(c)) for (d, *_), p, c in zip(data, prints, expected, strict=True))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in root}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    data, expected = [], []
    for g in range(40):
        text = [word() for _ in range(rng.randint(150, 300))]
        expected.append(g * 10)
        for k in range(3):
            own = list(text)
            if k == 2:
                own[rng.randrange(len(own))] = word()  # five shingles of hundreds change
            data.append((g * 10 + k, " ".join(own), "en", "s", 1))
    for i in range(60):
        data.append((1000 + i, " ".join(word() for _ in range(rng.randint(8, 200))), "en", "s", 1))
        expected.append(1000 + i)
    kept = nearcopies.keep_one(docs(spark, data))
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_keep_one_of_odd_rows(spark):
    frame = clashing(docs(spark))
    kept = nearcopies.keep_one(frame)
    assert kept.columns == frame.columns
    texts = [t for _, t, *_ in rows()]
    got = [r.text for r in kept.collect()]
    assert len(got) == len({t or "" for t in texts if t not in ("...   \n\t 12 34",)} | {"..."})
    assert nearcopies.keep_one(docs(spark, [])).count() == 0


def test_near_copies_equal_brute_force_around_the_limit(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sets, data = {}, []
    for g in range(120):  # pairs planted from 0.7 to 0.9; a changed stretch of c words takes c + 4 shingles
        n = rng.randint(60, 300)
        text = [word() for _ in range(n + 4)]
        aim = rng.choice([0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.9])
        lost = round(n * (1 - aim) / (1 + aim))
        other = text[: len(text) - lost] + [word() for _ in range(lost)]
        for k, t in enumerate((text, other)):
            data.append((2 * g + k, " ".join(t), "en", "s", 1))
            sets[2 * g + k] = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    base = [word() for _ in range(204)]
    for k in range(300):  # a large group of near copies, not all of which are similar to each other
        t = list(base)
        for at in rng.sample(range(200), rng.randint(0, 6)):
            t[at] = word()
        data.append((1000 + k, " ".join(t), "en", "s", 1))
        sets[1000 + k] = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    ids, root = sorted(sets), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j:
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs(spark, data)).collect()) == [i for i in ids if top(i) == i]


def linked(spark, monkeypatch, ids, prints):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long"))
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(None).collect()), key=str)


def test_null_and_tied_ids_link_by_their_texts(spark, monkeypatch):
    rng = random.Random(12)
    x, y = rng.getrandbits(64), rng.getrandbits(64)
    assert linked(spark, monkeypatch, [1, 2, None], [x, x ^ 0b111000, x ^ 0b111]) == sorted([(1, x, 1), (2, x ^ 0b111000, 1), (None, x ^ 0b111, 1)], key=str)
    assert linked(spark, monkeypatch, [5, 5, 3, 8], [x, y, x ^ 1, y ^ 1]) == sorted([(5, x, 3), (5, y, 5), (3, x ^ 1, 3), (8, y ^ 1, 5)], key=str)
    prints = []
    for _ in range(80):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(rng.randint(1, 6))]
    ids = [rng.choice([None, rng.randrange(60)]) for _ in prints]
    assert linked(spark, monkeypatch, ids, prints) == sorted(zip(ids, prints, classes(ids, prints, 3), strict=True), key=str)


def test_hot_prefix_keys_are_counted_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 20)
    rng = random.Random(6)
    lists = [[rng.choice([7, -7, rng.getrandbits(62), rng.randrange(30)]) for _ in range(rng.randint(0, 5))] for _ in range(400)]
    want = {}
    for keys in lists:
        for k in keys:
            want[k] = want.get(k, 0) + 1
    want = {k: n for k, n in want.items() if n > 20}
    frame = spark.createDataFrame([(keys,) for keys in lists], "keys array<long>")
    for parts in (1, 300):
        hot = nearcopies._hot_keys(frame.repartition(parts))
        assert dict(map(tuple, hot.collect())) == want
        turns = [nearcopies._some_hot(hot, k, 3)[0].tolist() for k in range(3)]
        assert sorted(sum(turns, [])) == sorted(want)


def test_keys_in_turns_find_the_same(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: rng.choice("abcdefghijklmnop") * 3
    base = [word() for _ in range(120)]
    data = []
    for k in range(250):
        own = list(base)
        for at in rng.sample(range(110), rng.randint(0, 5)):
            own[at] = f"{word()}{k % 7}"
        data.append((k, " ".join(own), "en", "s", 1))
    want = sorted(r.doc_id for r in nearcopies.keep_one(docs(spark, data)).collect())
    monkeypatch.setattr(nearcopies, "HOT", 16)
    monkeypatch.setattr(nearcopies, "SENT", 3)
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs(spark, data)).collect()) == want


def test_shingles_of_few_texts_are_counted_in_large_tables(spark):
    """A line that one text in a thousand holds is seen twice, or not, in a sample of two thousand. All texts are counted, so
    its shingles stand after rarer ones, and texts don't meet by it."""
    line = " ".join(f"line{i}" for i in range(20))
    data = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (" " + line if i % 1000 == 0 else "")) for i in range(20_000)]
    texts = spark.createDataFrame(data, "doc_id long, text string").withColumn("mark", F.xxhash64("text")).repartition(7)
    common, counts = nearcopies._common(texts, 5)
    whole = nearcopies.shingles(line.encode())
    assert common.tolist() == [k >> 16 for k in whole.tolist()] and set(counts.tolist()) == {20}
    own = nearcopies.shingles(data[0][1].encode())
    assert not set(nearcopies.prefix(own, common, counts).tolist()) & set(whole.tolist())


def test_only_the_commonest_shingles_are_sent(spark, monkeypatch):
    data = [(i, f"a b c d e{i % 3} f g h i j") for i in range(90)] + [(i, "k l m n o p") for i in range(90, 130)]
    monkeypatch.setattr(nearcopies, "COMMON", 4)
    texts = spark.createDataFrame(data, "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    common, counts = nearcopies._common(texts, 5)  # 15 shingles of 30 texts would be too many
    assert sorted(counts.tolist()) == [40, 40, 90] and counts[common.tolist().index(int(nearcopies.shingles(b"f g h i j")[0]) >> 16)] == 90
