"""Stored tables, listings, answers and embeddings on inputs that show their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators import answers, behaviour, browsing, collection, embedding, evaluation, filters, names, store
from heliograph.operators.index import KeywordIndex
from heliograph.plans.engine import Engine


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sessions_follow_arrival(spark):
    frame = spark.createDataFrame([(1, 100.0), (2, 2000.0), (3, 50.0), (4, 3801.0), (5, 5601.0)], "event_id long, ts double")
    assert [r.session for r in store.with_sessions(frame).orderBy("event_id").collect()] == [1, 2, 2, 3, 3]
    ends = spark.createDataFrame([(90.0, 7)], "ts double, session long")
    assert [r.session for r in store.with_sessions(frame, ends=ends).orderBy("event_id").collect()] == [7, 8, 8, 9, 9]


def test_sessions_of_users_go_on_over_blocks(spark):
    """One user has most of the events, some have none before; nulls are a user, too."""
    rng = np.random.default_rng(3)
    events = [(k, [1, 1, 1, 2, None, 5][int(rng.integers(6))], float(k * 700 + rng.integers(-3000, 3000))) for k in range(600)]
    ends = {1: (-5000.0, 4), 2: (3000.0, 2), 9: (1.0, 1)}
    want, known = {}, dict(ends)
    for k, user, ts in events:
        latest, number = known.get(user, (None, 0))
        number += latest is None or ts - latest > 1800
        known[user] = (ts if latest is None else max(ts, latest), number)
        want[k] = number
    frame = spark.createDataFrame(events, "event_id long, user_id long, ts double").withColumns({"who": F.lit("clash"), "block": F.lit(3)})
    before = spark.createDataFrame([(u, *e) for u, e in ends.items()], "user_id long, ts double, session long")
    got = store.with_sessions(frame, ends=before)
    assert got.columns == [*frame.columns, "session"]
    assert {r.event_id: r.session for r in got.collect()} == want


def test_sources_are_replaced_and_cleared(spark):
    rows = [(1, 1.0, "query", None, None, "q", None, 1), (2, 2.0, "file_opened", "f", "/f", None, "old", 9)]
    log = spark.createDataFrame(rows, store.EVENTS)
    new = spark.createDataFrame([(3, 5.0, "file_opened", "g", "/g", None, None, None), (4, 9000.0, "file_opened", "g", "/g", None, None, None)], store.EVENTS)
    assert sorted((r.event_id, r.source, r.session) for r in store.replace_source(log, "old", new).collect()) == [(1, None, 1), (3, "old", 10), (4, "old", 11)]
    assert [r.event_id for r in store.clear_source(log, "old").collect()] == [1] and store.clear_source(log).count() == 0
    assert [r.event_id for r in store.all_events(store.append_events(log, new.drop("source").withColumn("source", F.lit(None).cast("string")))).collect()] == [1, 2, 3, 4]


def test_lookup_prefers_the_exact_and_live(spark):
    rows = [("1", "/a/B.txt", False), ("2", "/a/b.txt", True), ("3", "/c", True)]
    records = spark.createDataFrame(rows, "file_id string, path string, deleted boolean")
    asked = spark.createDataFrame([("/a/b.txt",), ("/A/B.TXT",), ("/c",), ("/d",)], "path string")
    assert {r.asked: r.file_id for r in store.lookup(records, asked).collect()} == {"/a/b.txt": "2", "/A/B.TXT": "1", "/c": "3"}


def test_spans_at(spark):
    blocks = spark.createDataFrame([(1, 10, 20, 1), (1, 30, 40, 2), (2, 0, 5, 1)], "doc_id long, start long, end long, page long")
    asked = spark.createDataFrame([(1, "a", 0), (1, "b", 10), (1, "c", 25), (1, "d", 39), (1, "e", 99), (3, "f", 0)], "doc_id long, chunk_id string, start_offset long")
    assert {r.chunk_id: r.page for r in store.spans_at(asked, blocks).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": None}


def test_natural_order(spark):
    names = ["b 10", "B 2", "a", "É1", "e 2", "10", "9", "b 02"]
    got = [r.name for r in browsing.listed(spark.createDataFrame([(n, n == "9") for n in names], "name string, is_dir boolean"), 10).collect()]
    assert got == ["9", "10", "a", "B 2", "b 02", "b 10", "e 2", "É1"]


@pytest.mark.parametrize("query, expected", [
    ("a photo of a dog", "a dog"), ("couple photo", "couple"), ("show me pictures", "show me pictures"), ("dog on the beach", "dog on the beach"),
    ("photos from the", "photos from the"), ("find images with snow in", "snow"), ("the picture of the red car", "the red car"),
])
def test_picture_queries(spark, query, expected):
    assert value(spark, browsing.picture_query(F.lit(query))) == expected


def test_kept_filters(spark):
    frame = spark.createDataFrame([("type:pdf in:work size:>1mb before:2023 ext:pptx", "the big slides from 2023 at work")], "filters string, question string")
    row = browsing.kept_filters(frame).first()
    assert (row.kept, row.dropped) == ("in:work size:>1mb before:2023 ext:pptx", "type:pdf")


def test_media(spark):
    blank = lambda px: value(spark, browsing.blank(F.array(*map(F.lit, px))))
    assert blank([0] * 200 + [50]) and not blank([0] * 90 + [20] * 10) and not blank([0] * 500 + [64])
    taken = lambda *a: value(spark, browsing.captured_at(*(F.lit(x) for x in a[:2]), F.lit(a[2]).cast("double"), 0.0))
    assert taken("2020:01:02 03:04:05", None, 1.0) == "2020-01-02T03:04:05" and taken("junk", None, 86400.0) == "1970-01-02T00:00:00" and taken(None, None, None) == "1970-01-01T00:00:00"
    frames = spark.createDataFrame([(f, float(t)) for f, n in ((1, 7), (2, 239), (3, 240), (4, 1000)) for t in range(n)], "file_id long, t double")
    assert {r.file_id: r["count"] for r in browsing.keyframes(frames).groupBy("file_id").count().collect()} == {1: 7, 2: 120, 3: 120, 4: 120}


def test_answers(spark):
    found = spark.createDataFrame([(1, "b", 0, 1, "one"), (1, "a", 0, 2, "two"), (1, "b", 1, 1, "more"), (1, "b", 2, 1, "one"), (1, "c", 1, 2, None)], "question_id long, file_id string, turn int, rank int, text string")
    assert {r.file_id: (r.number, r.text) for r in answers.numbered(found).collect()} == {"b": (1, "one\n…\nmore"), "a": (2, "two"), "c": (3, "")}
    said = spark.createDataFrame([(1, "The invoice of March is 1200 euros, due on the 14th", [2, 1, 3])], "question_id long, answer string, cited array<int>")
    sources = spark.createDataFrame([(1, 1, "March invoice: 1200 euros due 14th"), (1, 2, "April invoice in euros"), (1, 3, "something else")], "question_id long, number int, text string")
    assert answers.trimmed_citations(said, sources).first().cited == [1]
    premise = lambda q, s: value(spark, answers.premise_problem(F.lit(q), F.lit(s)))
    assert premise("what was due in March 2021", "paid 3.14 in 2021") is None
    assert premise("what was due in April 2021", "paid 3.14 in 2021") == "the sources never mention april"
    assert premise("how many movies are there", "28 files in a report") == "the question counts “movies” but no source mentions it"
    assert premise("how many movies are there", "one movie") is None
    nothing, broken, back = (lambda t, f=f: value(spark, f(F.lit(t))) for f in (answers.says_nothing, answers.breaks_off, answers.refers_back))
    assert nothing("The sources do not mention a date. It is 5.") and nothing("There is no information about this in the documents.") and not nothing("It is 5. Nothing else is mentioned.")
    assert broken("The date is .") and not broken("The date is Monday.")
    assert back("what about the other one?") and not back("how many photos of Rome")
    assert value(spark, answers.count_note(F.lit("How many photos did we take"))) and value(spark, answers.count_note(F.lit("how many people came"))) is None


def test_evaluation(spark):
    score = lambda n, **s: value(spark, evaluation.component_score(F.lit(n), **{k: F.lit(v).cast("double") for k, v in s.items()}))
    assert score(30, accuracy=0.8, reliability=0.6) == round((0.8 * 0.35 + 0.6 * 0.25) / 0.6 * 100, 1)
    assert score(10, accuracy=1.0, reliability=None) == 75.0 and score(5, accuracy=None) is None
    events = [(1, 1.0, "query", " Rome ", None, None), (2, 2.0, "query", "rome", None, None), (3, 3.0, "query", "x", "old", None), (4, 4.0, "query", "y", None, "ask"), (5, 5.0, "file_opened", None, None, None)]
    frame = spark.createDataFrame(events, "event_id long, ts double, kind string, query string, source string, mode string")
    assert [(r.query, r.ts) for r in evaluation.training_queries(frame).collect()] == [("rome", 2.0)]


def test_hashed_embeddings(spark):
    rows = embedding.hashed(["the red car", "a red car here", "deep blue sea", ""])
    assert np.allclose(np.linalg.norm(rows[:3], axis=1), 1) and not rows[3].any()
    assert rows[0] @ rows[1] > rows[0] @ rows[2] + 0.2
    frame = spark.createDataFrame([(1, "the red car"), (2, None)], "query_id long, query string")
    got = {r.query_id: r.embedding for r in embedding.embed(frame, "query").collect()}
    assert np.allclose(got[1], rows[0]) and not any(got[2])
    assert np.isclose(np.linalg.norm(embedding.embed_picture_queries(frame).where("query_id = 1").first().query_vec), 1)


def test_topic_affinity_either_way(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    centres = spark.createDataFrame([(t, i, float(x)) for t in range(3) for i, x in enumerate(rng.normal(size=5))], "topic long, i long, x double")
    sent = sorted(map(tuple, behaviour.topic_affinity(vectors, centres).collect()))
    monkeypatch.setattr(behaviour, "SENT", 1)
    assert sent == sorted(map(tuple, behaviour.topic_affinity(vectors, centres).collect()))


def test_normal_forms(spark):
    frame = spark.createDataFrame([("éa",), ("éa",), (None,)], "t string")
    assert [r[0] for r in frame.select(T.nfc("t")).collect()] == ["éa", "éa", None]
    assert [r[0] for r in frame.select(T.nfd("t")).collect()] == ["éa", "éa", None]
    assert [r[0] for r in frame.select(T.fold("t")).collect()] == ["ea", "ea", None]
    assert value(spark, T.fold(F.lit("ŁÓDŹ Ầ ğ"))) == "łodz a g"


def test_engine_scope_and_escalation(spark, tmp_path):
    """Filters, deleted and vanished files stand before the best are taken; a query without strong results goes on once."""
    records = [(i, f"/src/{'a' if i < 60 else 'b'}/doc_{i}.txt", "txt", 10, float(i), i in (61, 62), None) for i in range(100)]
    records = spark.createDataFrame(records, "doc_id long, path string, ext string, size long, modified_time double, deleted boolean, audio_only boolean")
    data = [(f"{i}#0", i, "rare words here" + (" more" if i >= 90 else "")) for i in range(100)]
    chunks = spark.createDataFrame(data, "chunk_id string, doc_id long, content string")
    index = KeywordIndex.create(str(tmp_path / "i"), chunks)
    asked = spark.createDataFrame([(1, "rare words in:/b/"), (2, '"words here" in:doc_7'), (3, "rare words")], "query_id long, query string")
    gone = records.where("doc_id <> 63")
    engine = Engine(records, index, roots=spark.createDataFrame([("/SRC/b",), ("/src/a/doc_7.txt",)], "root string"), listing=gone.select("path"))
    got = {}
    for r in engine.search(asked, "keyword", 100).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    whole = set(range(60, 100)) - {61, 62, 63}
    assert len(got[1]) == 20 and got[1] <= whole
    assert got[2] == {7} | set(range(70, 80)) and len(got[3]) == 20 and got[3] <= whole | {7}

    vectors = embedding.embed(chunks, "content").select("chunk_id", "doc_id", "embedding")
    engine = Engine(records, index, vectors)
    far = spark.createDataFrame([(9, "what might these unknown things possibly be about")], "query_id long, query string")
    vecs = embedding.embed(spark.createDataFrame([(9, "rare more")], "query_id long, text string"), "text").select("query_id", F.col("embedding").alias("query_vec"))
    plain = engine.search(far, query_vecs=vecs).collect()
    assert {r.tier for r in plain} <= {"hybrid"}
    logits = chunks.select(F.lit(9).cast("long").alias("query_id"), "chunk_id", F.when(F.col("doc_id") == 95, 3.0).otherwise(-1.0).alias("logit"))
    again = engine.search(far, query_vecs=vecs.withColumn("query_vec", F.transform("query_vec", lambda x: x * 0.2)), logits=logits).collect()
    assert {r.tier for r in again} <= {"hybrid", "hybrid+rerank"}


def test_described_filters(spark):
    parsed = filters.parse_queries(spark.createDataFrame([(1, "type:pdf size:>=2mb in:work"), (2, "words")], "query_id long, query string"))
    assert {r.query_id: r.told for r in filters.described(parsed).collect()} == {1: ["type pdf", "larger than 2 MB", "in “work”"], 2: []}


def test_quick_answers(spark):
    asked = spark.createDataFrame([(1, "when is the march invoice due"), (2, "deposit"), (3, "meeting in september"), (4, "unknown words")], "question_id long, question string")
    passages = [
        (1, "a", "march invoice.txt", 1, "Thanks a lot. The amount is due on day 14. Goodbye to you all."),
        (1, "b", "april invoice.txt", 2, "The invoice is due on the 30th of April."),
        (2, "c", "lease.txt", 1, "The deposit is large. The deposit is 900 euros."),
        (3, "d", "notes.txt", 1, "The meeting is in October."),
        (4, "e", "x.txt", 1, "Nothing of the kind here."),
    ]
    frame = spark.createDataFrame(passages, "question_id long, chunk_id string, filename string, rank int, content string")
    got = {r.question_id: (r.chunk_id, r.sentence, r.score) for r in collection.quick_answer(asked, frame).collect()}
    assert got == {1: ("a", "The amount is due on day 14.", 2.5), 2: ("c", "The deposit is 900 euros.", 1.5)}


def test_why_missing_tells_what_is_no_file(spark):
    asked = spark.createDataFrame([("apple.txt",), ("*.txt",), ("...",), ("x.exe",), ("w.md",), ("b.txt",), ("zzz.txt",)], "name string")
    states = spark.createDataFrame([("apple.txt", 1, "indexed"), ("w.md", 5, "waiting"), ("bb.txt", 1, "indexed")], "name string, tier int, state string")
    got = {r.name: r.state for r in collection.why_missing(asked, states).collect()}
    assert got == {"apple.txt": "indexed", "*.txt": "invalid", "...": "invalid", "x.exe": "unsupported", "w.md": "failed", "b.txt": "similar", "zzz.txt": "unknown"}
    assert {r.name: r.state for r in collection.why_missing(asked, states, True).collect()}["w.md"] == "indexing"


def test_words_of_picture_queries(spark):
    dictionary = spark.createDataFrame([("pizza", 9000), ("cat", 50_000), ("act", 60_000), ("mountain", 8000), ("recieve", 125), ("receive", 90_000), ("ack", 379), ("house", 7000)], "term string, occurrences long")
    vocab = spark.createDataFrame([("lisboa",)], "term string")
    asked = spark.createDataFrame([(w,) for w in ("pizaa", "cat", "montain", "recieve", "cak", "lisboa", "x", "2024", "qqqqq", "ohuse")], "word string")
    got = {r.word: (r.correction, r.unknown) for r in names.checked_words(asked, dictionary, vocab).collect()}
    keep = (None, False)
    assert got == {"pizaa": ("pizza", False), "cat": keep, "montain": ("mountain", False), "recieve": ("receive", False), "cak": (None, True), "lisboa": keep, "x": keep, "2024": keep, "qqqqq": (None, True), "ohuse": ("house", False)}


def test_common_words_stay(spark):
    queries = spark.createDataFrame([(1, "servers qqzz")], "query_id long, query string")
    vocab = spark.createDataFrame([("serves", 5)], "term string, occurrences long")
    english = spark.createDataFrame([("servers", 900)], "term string, occurrences long")
    assert names.correct_queries(queries, vocab).first().corrected == "serves qqzz"
    assert names.correct_queries(queries, vocab, english).first().corrected == "servers qqzz"


def test_topic_labels_of_names(spark):
    rows = [(1, "the", 0.5, False), (1, "the", 0.5, False), (1, "trip", 0.5, True), (1, "rome", 0.5, False), (2, "rome", 0.5, False)]
    frame = spark.createDataFrame(rows, "topic long, term string, score double, in_name boolean")
    assert [r.term for r in behaviour.topic_labels(frame).where("topic = 1").orderBy("rank").collect()] == ["trip", "rome"]


def test_judged_equals_all_pairs(spark):
    from heliograph.operators import retrieval

    rng = np.random.default_rng(5)
    vecs = rng.integers(-3, 4, (300, 6)).astype(float)
    rows = [(k, vecs[k].tolist() if k % 41 else None, int(rng.integers(40)), bool(k % 3)) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, may boolean").repartition(7)
    asked = frame.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vec", "label as own")
    want = set()
    for q, x, own, _ in rows[::20]:
        if x is None:
            continue
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), 6), v, label == own and may) for v, y, label, may in rows if v != q and y is not None)
        n = sum(r for *_, r in near)
        firsts = {next((k for k, (*_, r) in enumerate(near) if r == kind), None) for kind in (True, False)}
        want |= {(q, v, d, k + 1, r, n) for k, (d, v, r) in enumerate(near) if k < 4 or k in firsts}
    got = [(r.query_id, r.vec_id, r.distance, r["rank"], r.relevant, r.n_relevant) for r in retrieval.judged(asked, frame, 4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_snippets_hold_most_of_the_words_in_the_shortest_stretch(spark):
    import random

    from heliograph.operators import retrieval

    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["a", "B.", "c-d", "e", "x", "y", "zé", ""]) for _ in range(rng.randrange(40))), [rng.choice("abcdex") for _ in range(rng.randrange(4))] + ["ze"]) for _ in range(300)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, content string, words array<string>")
    got = {r.k: r for r in frame.select("k", retrieval.best_window(F.split("content", " "), F.col("words")).alias("w"), F.col("content")).collect()}
    fold = lambda p: {t for t in p.lower().replace("é", "e").replace(".", " ").replace("-", " ").split()}
    for k, (content, words) in enumerate(rows):
        pieces = [fold(p) & set(words) for p in content.split(" ")]
        most = len(set().union(*pieces))
        spans = [(j - i, i + 1, j + 1) for i in range(len(pieces)) for j in range(i, len(pieces)) if len(set().union(*pieces[i : j + 1])) == most]
        want = min(spans)[1:] if most else None
        assert (got[k].w and tuple(got[k].w)) == want, (content, words)
    told = retrieval.snippets(spark.createDataFrame([("one two three four five six Seven eight nine seven ten", ["seven", "ten"]), ("no", ["x"])], "content string, words array<string>"))
    assert [r.snippet for r in told.collect()] == ["...five six **Seven** eight nine **seven** **ten**", None]


def test_profiles_go_on_from_their_last_version(spark, tmp_path):
    from heliograph.operators.profile import Profile

    form = "user_id long, ts double, at timestamp, kind string, doc_id long, results array<long>"
    day, base = 86400.0, 1_700_000_000.0
    from datetime import datetime, timezone

    events = [(u, base + k * day / 3, datetime.fromtimestamp(base + k * day / 3, timezone.utc), ("file_opened", "query", "result_clicked")[k % 3], None if k % 3 == 1 else k % 4, [1, 2, 9] if k % 3 == 1 else None) for k in range(60) for u in (1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, form)
    active, end = spark.createDataFrame([(k,) for k in range(4)], "doc_id long"), base + 30 * day
    step, whole = Profile(spark, str(tmp_path / "a")), Profile(spark, str(tmp_path / "b"))
    assert step.activity(active).count() == 0 and step.versions() == []
    late = events[10:12]  # arrive with a later refresh than their time says
    for low, high, now in ((0, 50, base + 10 * day), (50, 120, end)):
        step.refresh(frame([e for e in events[low:high] if e not in late] + (late if low else [])), now)
    step.refresh(frame([]), end)
    whole.refresh(frame(events), end)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(step.activity(active)) == rows(whole.activity(active)) and step.activity(active).count() > 4
    assert rows(step.slot_histogram()) == rows(whole.slot_histogram())
    assert [v for v, _ in step.versions()] == [1, 2, 3]
    with pytest.raises(ValueError):
        step.refresh(frame([]), base)


def test_a_stored_router_routes_as_it_was_fitted(spark, tmp_path):
    from heliograph.operators import learning

    rng = np.random.default_rng(1)
    rows, truth, rules = [], [], []
    for k in range(150):
        words = int(rng.integers(1, 14))
        rows.append((k, words, words, int(rng.integers(0, 2)), bool(k % 2), 0.2, 1, 1.0 if words < 4 else 0.0, False))
        truth.append((k, "filename" if words < 4 else "keyword" if words < 8 else "hybrid"))
        rules.append((k, "metadata" if k % 50 == 0 else "keyword"))
    features = spark.createDataFrame(rows, "query_id long, words int, content_words int, unknown_words int, question boolean, stopword_ratio double, clauses int, filename_coverage double, has_filters boolean")
    label, ruled = spark.createDataFrame(truth, "query_id long, label string"), spark.createDataFrame(rules, "query_id long, tier string")
    fitted = learning.LearnedRouter.fit(features, label, ruled, 3)
    assert fitted.active and fitted.accuracy["queries"] == 150 and fitted.accuracy["learned"] > 0.7 > fitted.accuracy["rules"]
    assert sorted(r.fold for r in fitted.scores.collect()) == list(range(5))
    fitted.save(str(tmp_path))
    stored = learning.LearnedRouter.load(spark, str(tmp_path))
    rows = lambda router: sorted(map(tuple, router.route(features, ruled).collect()))
    assert rows(stored) == rows(fitted) and {t for k, t in rows(stored) if k % 50 == 0} == {"metadata"}
    few = learning.LearnedRouter.fit(features.limit(20), label, ruled)
    assert not few.active and rows(few) == sorted(rules_ for rules_ in map(tuple, ruled.collect()))
