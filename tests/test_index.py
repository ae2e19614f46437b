"""The stored index against a search by definition, and its writes."""

import math
import random
import re

import pytest

from heliograph.operators.index import KeywordIndex

WORDS = "ash beech cedar date elm fir gum hazel ivy jute".split()


def corpus(seed, n=300):
    rng = random.Random(seed)
    weights = [2.0**-i for i in range(len(WORDS))]
    return [(f"{d}#{c}", d, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 30)))) for d in range(n) for c in range(rng.randint(1, 3))]


def brute(chunks, query, mode, scope=None):
    line = re.findall("[a-z0-9]+", query.lower())
    terms = list(dict.fromkeys(line))
    held = {c: t.split() for c, _, t in chunks}
    mean = sum(map(len, held.values())) / max(1, len(held))
    idf = {t: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for t in terms for n in [sum(t in w for w in held.values())]}
    out = {}
    for c, d, _ in chunks:
        w = held[c]
        have = sum(t in w for t in terms)
        places = sum(w[i : i + len(line)] == line for i in range(len(w)))
        good = {"all": have == len(terms), "half": have >= max(1, math.ceil(len(terms) / 2)), "phrase": places > 0}[mode]
        if line and good and (scope is None or d in scope):
            out[c] = round(sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w), 5), places
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    from heliograph.operators import index

    index.SHARD = 64
    data = corpus(1)
    return data, KeywordIndex.create(str(tmp_path_factory.mktemp("index")), frame(spark, data))


def frame(spark, data):
    return spark.createDataFrame(data, "chunk_id string, doc_id long, content string")


QUERIES = ["ash", "beech cedar", "Ash ash beech", "jute ivy hazel", "zebra", "zebra ash", "", "date elm fir gum", "ash beech ash", "ivy-ivy"]


@pytest.mark.parametrize("mode", ["all", "half", "phrase"])
@pytest.mark.parametrize("scoped", [False, True])
def test_search_equals_brute_force(spark, built, mode, scoped):
    data, index = built
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    scope = set(range(0, 300, 3)) if scoped else None
    inside = spark.createDataFrame([(d,) for d in scope], "doc_id long") if scoped else None
    got = {}
    for r in index.search(asked, mode, None, inside).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = round(r.score, 5), r.places
    best = {}
    for r in index.search(asked, mode, 5, inside).collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    for q, query in enumerate(QUERIES):
        expected = brute(data, query, mode, scope)
        assert {c: s for c, (s, _) in got.get(q, {}).items()} == pytest.approx({c: s for c, (s, _) in expected.items()}, abs=2e-5)
        if mode == "phrase":
            assert {c: n for c, (_, n) in got.get(q, {}).items()} == {c: n for c, (_, n) in expected.items()}
        assert len(best.get(q, [])) == min(5, len(expected))
        assert sorted(c for _, c in best.get(q, [])) == sorted(sorted(got.get(q, {}), key=lambda c: (-got[q][c][0], c))[:5]) or len({s for s, _ in got[q].values()}) < len(got[q])


def test_blocks_of_queries(spark, built, monkeypatch):
    from heliograph.operators import index as module

    data, index = built
    asked = spark.createDataFrame([(i, WORDS[i % 10]) for i in range(30)], "query_id long, query string")
    whole = sorted(map(tuple, index.search(asked, "all", 3).collect()))
    monkeypatch.setattr(module, "BLOCK", 7)
    assert sorted(map(tuple, index.search(asked, "all", 3).collect())) == whole


def test_writes(spark, tmp_path):
    data = corpus(2, 120)
    index = KeywordIndex.create(str(tmp_path / "i"), frame(spark, data), "m1")
    assert {r.term: (r.df, r.occurrences) for r in index.terms().collect()} == {w: (sum(w in t.split() for _, _, t in data), sum(t.split().count(w) for _, _, t in data)) for w in WORDS}

    def holds(i, expected):
        assert sorted(map(tuple, i.chunks().collect())) == sorted(expected)
        asked = spark.createDataFrame([(1, "ash beech"), (2, "new")], "query_id long, query string")
        got = {}
        for r in i.search(asked, "all", None).collect():
            got.setdefault(r.query_id, set()).add(r.chunk_id)
        for q, query in ((1, "ash beech"), (2, "new")):
            assert got.get(q, set()) == set(brute(expected, query, "all"))

    holds(index, data)
    more = index.append(frame(spark, [("500#0", 500, "new ash")]))
    holds(more, [*data, ("500#0", 500, "new ash")])
    holds(index, data)  # an older version is still readable
    changed = more.replace(spark.createDataFrame([(7,), (8,)], "doc_id long"), frame(spark, [("7#0", 7, "new beech ash")]))
    expected = [*(c for c in data if c[1] not in (7, 8)), ("500#0", 500, "new ash"), ("7#0", 7, "new beech ash")]
    holds(changed, expected)
    less = changed.purge(spark.createDataFrame([(500, True), (9, False)], "doc_id long, deleted boolean"))
    expected = [c for c in expected if c[1] != 500]
    holds(less, expected)
    less.clean()
    holds(KeywordIndex.open(spark, str(tmp_path / "i")), expected)
    again = KeywordIndex.open(spark, str(tmp_path / "i"), "m1")
    assert again.version == less.version
    empty = KeywordIndex.open(spark, str(tmp_path / "i"), "m2")
    holds(empty, [])
    assert empty.model() == "m2"
    holds(empty.append(frame(spark, data)), data)


def test_a_write_reads_no_other_postings(spark, tmp_path, monkeypatch):
    """Appending reads its own batch's postings, replacing those of the shards that it drops; the vocabulary stays that of
    the chunks, through merges of runs, and so do totals."""
    rng = random.Random(4)
    data = {d: [(f"{d}#0", d, " ".join(rng.choices(WORDS, k=rng.randint(0, 9))))] for d in range(30)}
    index = KeywordIndex.create(str(tmp_path), frame(spark, sum(data.values(), [])))
    asked, read = [], KeywordIndex._read

    def watched(self, name, shards=None):
        asked.append((name, None if shards is None else shards.count()))
        return read(self, name, shards)

    def check():
        texts = [c[2].split() for own in data.values() for c in own]
        want = {w: (sum(w in t for t in texts), sum(t.count(w) for t in texts)) for w in WORDS}
        assert {r.term: (r.df, r.occurrences) for r in index.terms().collect()} == {w: n for w, n in want.items() if n[0]}
        assert {r.term: r.df for r in index.terms(spark.createDataFrame([("ash",), ("zebra",)], "term string")).collect()} == {"ash": want["ash"][0]}
        totals = spark.read.parquet(f"{index.folder}/model-{index.version}").first()
        assert (totals.n_chunks, totals.n_words) == (len(texts), sum(map(len, texts)))

    monkeypatch.setattr(KeywordIndex, "_read", watched)
    for d in range(30, 36):
        data[d] = [(f"{d}#0", d, "ash " * d)]
        index = index.append(frame(spark, data[d]))
    assert not [a for a in asked if a[0] == "postings"]
    check()
    assert len(index._runs()) < 6
    data[3], data[31] = [("3#0", 3, "jute new")], []
    new = frame(spark, data[3])
    asked.clear()
    index = index.replace(spark.createDataFrame([(3,), (31,)], "doc_id long"), new)
    assert [a for a in asked if a[0] == "postings"] == [("postings", 2)]
    data[3] = [("3#0", 3, "jute")]
    WORDS.append("new")
    try:
        data[3] = [("3#0", 3, "jute new")]
        check()
        index = index.compact()
        index.clean()
        check()
    finally:
        WORDS.remove("new")
    assert len(index._runs()) == 1


def test_rows_are_written_where_chunks_are_read(spark, tmp_path):
    """Nothing is exchanged to make postings: however chunks are dealt to batches, a shard that one task reads has one row for each
    term, in their order, which tells chunks and words."""
    import numpy as np
    import pyarrow as pa

    from heliograph.operators.index import _inverted

    data = corpus(3, 100)
    rows = [(i // 40, i % 40, t.split(), c, d) for i, (c, d, t) in enumerate(data)]
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("words", pa.list_(pa.string())), ("ids", pa.string()), ("docs", pa.int64())])
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    want = {}
    for shard, place, words, *_ in rows:
        for i, w in enumerate(words):
            want.setdefault((shard, w), []).append((place, i))
    for size in (7, 40, 1000):
        told = [r for b in _inverted(whole.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
        got = [(r["shard"], r["term"]) for r in told if r["term"]]
        assert got == sorted(want)
        for r in told:
            if r["term"]:
                assert list(zip(np.repeat(r["place"], r["tf"]).tolist(), r["pos"], strict=True)) == want[r["shard"], r["term"]]
                assert (r["chunks"], r["words"]) == (len(r["place"]), len(r["pos"]))
        assert [c for r in told if not r["term"] for c in r["ids"]] == [c for c, _, _ in data]


def test_ties_send_no_more_than_asked_for(spark, tmp_path, monkeypatch):
    """A shard of copies sends the first of them by name, not all that tie."""
    from heliograph.operators import index as module

    sent = []
    ranked = module.ranked
    monkeypatch.setattr(module, "ranked", lambda hits, k: sent.append(hits.count()) or ranked(hits, k))
    index = KeywordIndex.create(str(tmp_path), frame(spark, [(f"{d:03}", d, "ash fir") for d in range(200)]).coalesce(1))
    got = index.search(spark.createDataFrame([(1, "ash")], "query_id long, query string"), "all", 5)
    assert sorted(r.chunk_id for r in got.collect()) == [f"{d:03}" for d in range(5)]
    assert sent[0] <= 5 * 4  # 64 places to a shard


def test_a_line_of_tokens_has_the_same_words(spark):
    """Chunks are sent to Python as a string each, whose words are those of tokens, however odd the text."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from heliograph.functions.text import token_line, tokens
    from heliograph.operators.index import words_of

    texts = ["Ash, beech!", "", None, " \t", "...", "Crème brûlée N° 5", "été", "İstanbul STRASSE ß", "x_y-z", "𝐀𝐁 ab", "٣٤ 12½", "Я не знаю", "a b c", "ﬁn", "ΑΣ ΟΔΟΣ", "1\x002"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", tokens("t").alias("words"), token_line("t").alias("line")).orderBy("i").collect()
    assert words_of(pa.array([r.line for r in rows], pa.string())).to_pylist() == [r.words or [] for r in rows]
    plan = spark.range(1).select(F.lit("ash").alias("t")).select(token_line("t"))
    assert plan.schema[0].dataType.simpleString() == "string"
