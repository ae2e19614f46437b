"""Semantics that small inputs show best."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.config import DEFAULTS
from heliograph.fixtures import chunk_words
from heliograph.functions import text as T
from heliograph.operators import behaviour, filters, lifecycle, names, ranking
from heliograph.plans import questions
from heliograph.sources import extract, scan, transcripts
from heliograph.streaming.events import apply_file_events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


def test_phonetic_keys(spark):
    key = lambda w: one(spark, w, T.phonetic_key)
    assert key("Phone") == key("fone")
    assert key("knight") == key("nit")
    assert key("") == ""
    assert key("demo 3") != key("demo")


def test_tidy_keeps_filters_and_decimals(spark):
    assert one(spark, "the the bread ,making  type:pdf 3.5", T.tidy_query) == "the bread, making type:pdf 3.5"


def test_chunks_cover_all_words(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(250)))), (2, ""), (3, "a")], "doc_id long, text string")
    rows = chunk_words(docs, 100, 20).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in rows] == [(1, 0, 100), (1, 80, 180), (1, 160, 250), (3, 0, 1)]
    with pytest.raises(ValueError):
        chunk_words(docs, 10, 10)


def test_bad_filter_values_are_dropped(spark):
    q = spark.createDataFrame([(1, "plan size:huge after:soon type:PDF type:.docx")], "query_id long, query string")
    r = filters.parse_queries(q).first()
    assert (r.words, r.file_type, r.after, r.size_min) == ("plan", "docx", None, None)


def test_session_gap_is_strict(spark):
    rows = [(1, 1, 0.0), (2, 1, 1800.0), (3, 1, 3601.0)]
    got = behaviour.sessions(spark.createDataFrame(rows, "event_id long, user_id long, ts double")).orderBy("event_id").collect()
    assert [r.session for r in got] == [1, 1, 2]


def test_secondary_chunks_never_beat_one_best(spark):
    hits = [(1, f"a#{i}", 1, 0.5, i + 2, None, None, 0.010) for i in range(50)] + [(1, "b#0", 2, 0.9, 1, None, None, 0.016)]
    frame = spark.createDataFrame(hits, "query_id long, chunk_id string, doc_id long, keyword_score double, keyword_rank long, distance double, semantic_rank long, fused double")
    best = ranking.to_files(frame).orderBy(F.desc("score")).first()
    assert best.doc_id == 2


def test_confidence_ignores_literal_results_for_the_best(spark):
    rows = [(1, 1, 0.5, "c", 3.0, 1.0), (1, 2, 0.4, "d", None, 1.47), (1, 3, 0.3, "e", None, 1.44)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, score double, chunk_id string, keyword_score double, distance double")
    got = {r.doc_id: r.confidence for r in ranking.confidence(frame).collect()}
    assert got == {1: "strong", 2: "strong", 3: "strong"}  # 1.47 is near 1.44, the best by meaning alone


def test_weak_results_vanish_beside_literal_strong_ones(spark):
    rows = [(1, 1, 0.5, "c", 3.0, None, "strong"), (1, 2, 0.4, "d", None, 1.55, "weak")]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, score double, chunk_id string, keyword_score double, distance double, confidence string")
    assert [r.doc_id for r in ranking.prune(frame).collect()] == [1]


def test_near_ties_follow_the_leader(spark):
    rows = [(1, i, i, "strong", s, b, [str(i)]) for i, (s, b) in enumerate([(0.5, 0.0), (0.4996, 0.9), (0.4992, 1.0)], 1)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, rank long, band string, score double, boost double, tokens array<string>")
    assert [r.doc_id for r in ranking.near_ties(frame, DEFAULTS.tie_window).orderBy("rank").collect()] == [2, 1, 3]


def test_spelling_prefers_extensions(spark):
    words = spark.createDataFrame([("remind",), ("servwr",)], "word string")
    vocab = spark.createDataFrame([("demand", 90), ("reminder", 1), ("server", 5)], "term string, occurrences long")
    assert {r.word: r.correction for r in names.closest_word(words, vocab).collect()} == {"remind": "reminder", "servwr": "server"}


def test_rename_needs_the_old_path_to_be_gone(spark):
    old = spark.createDataFrame([("/a", "h"), ("/b", "k")], "path string, hash string")
    new = spark.createDataFrame([("/a", "h"), ("/c", "h"), ("/d", "k")], "path string, hash string")
    got = {r.path: r.status for r in lifecycle.snapshot_diff(old, new).collect()}
    assert got == {"/a": "unchanged", "/c": "new", "/d": "renamed"}


def test_file_events(spark):
    records = spark.createDataFrame([("1", "/r/a/x", "h", False), ("2", "/r/b/y", "k", False), ("3", "/r/z", "l", False)], "file_id string, path string, hash string, deleted boolean")
    events = spark.createDataFrame([("/r/a", "moved", None, "/r/c", 1), ("/r/b", "deleted", None, None, 2), ("/r/z", "modified", "m", None, 3), ("/r/z", "created", "old", None, 1)], "path string, kind string, hash string, target string, version long")
    got = {r.file_id: (r.path, r.hash, r.deleted) for r in apply_file_events(records, events).collect()}
    assert got == {"1": ("/r/c/x", "h", False), "2": ("/r/b/y", "k", True), "3": ("/r/z", "m", False)}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_extraction(spark):
    w = 'xmlns:w="w"'
    para = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    word = zipped(word__document_xml=f"<w:document {w}><w:body>{para('Top', 'Heading1')}{para('Sub', 'Heading2')}{para('Body')}</w:body></w:document>")
    files = [
        ("a.html", b"<head><title>no</title><body><h1>Yes</h1><script>x</script>a&amp;b"),
        ("b.docx", word),
        ("c.csv", b"a;b\n1;2\n"),
        ("d.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9\par " + b"\\" + b"u8364?5}"),
        ("e.eml", b"Subject: Hi\nFrom: a@b\nContent-Type: text/html\n\n<p>Hello</p>"),
        ("f.docx", b"not a zip"),
        ("g.txt", "ü".encode("utf-16")),
    ]
    got = {}
    for r in extract.extract(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "block").collect():
        got.setdefault(r.path, []).append(r)
    assert got["a.html"][0].text.split() == ["Yes", "a&b"]
    assert [(r.text, r.section, r.heading) for r in got["b.docx"]] == [("Top", "Top", None), ("Sub", "Top", "Sub"), ("Body", "Top", "Sub")]
    assert got["c.csv"][0].text == "a b\n1 2"
    assert got["d.rtf"][0].text == "café\n€5"
    assert got["e.eml"][0].text == "Subject: Hi\nFrom: a@b\n\nHello"
    assert got["f.docx"][0].text is None and "BadZipFile" in got["f.docx"][0].error
    assert got["g.txt"][0].text == "ü"


def brute_loops(words):
    """Phrases said again and again, tried at every place from the left; the longest stretch stands."""
    out, i = [], 0
    while i < len(words):
        spans = [(0, 1)]
        for p in range(8, 0, -1):
            rounds = 1
            while words[i + rounds * p : i + rounds * p + p] == words[i : i + p] and len(words[i : i + p]) == p:
                rounds += 1
            if rounds >= (4 if p == 1 else 3) and rounds * p >= spans[-1][0]:
                spans.append((rounds * p, p))
        span, p = spans[-1]
        out += words[i : i + p]
        i += span or 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_loops(words):
    assert transcripts.without_loops(" ".join(words)).split() == brute_loops(words)


def test_transcript_cleaning(spark):
    assert transcripts.without_loops("no no no") == "no no no"
    assert transcripts.without_loops("go go go, go on") == "go on"
    assert transcripts.window_text("[Music] thank you") == ""
    assert transcripts.window_text("thank you", of_file=False) == "thank you"
    assert transcripts.window_text("we go on " * 6) == "" and transcripts.window_text(None) == ""
    windows = spark.createDataFrame([(1, 30.0, "la la la la"), (1, 0.0, "Say it, say it"), (1, 60.0, "(music)"), (2, 0.0, "um"), (1, 90.0, "say it")], "file_id long, start double, text string")
    assert {r.file_id: r.text for r in transcripts.transcripts(windows).collect()} == {1: "Say it, say it la say it", 2: ""}


def test_spoken_names(spark):
    names = ["Landlord Letter", "gym plan", "expenses", "photo kilo", "quarterly report"]
    snap = lambda t: transcripts.snapped(t, names)
    assert snap("learn lord letter") == "Landlord Letter"
    assert snap("jim plan") == "gym plan"
    assert snap("open the quarterley report") == "open the quarterly report"
    assert snap("explain") == "explain"  # shares consonants with expenses only
    assert snap("video call") == "video call"
    assert snap("we talked about the jim plan of last week") == "we talked about the jim plan of last week"
    assert snap("gym plan") == "gym plan"
    frame = spark.createDataFrame([(1, "jim plan")], "query_id long, query string")
    assert transcripts.snap(frame, spark.createDataFrame([(n,) for n in names], "name string")).first().snapped == "gym plan"
    for w in ("Phone", "knight", "a", "", "Xylophone", "ghost", "city", "aardvark"):
        assert transcripts.spoken_key(w) == one(spark, w, T.phonetic_key)


def test_type_groups_keep_all_formats(spark):
    by = lambda kind: {e for (e,) in spark.createDataFrame([(e,) for e in "pdf pptx xlsx csv py rtf html epub msg jpg avif mp3 aif opus mp4 3gp wmv zip".split()], "e string").where(filters.in_type(F.lit(kind), F.col("e"), F.lit(None).cast("boolean"))).collect()}
    assert by("document") == set("pdf pptx xlsx csv py rtf html epub msg".split())
    assert by("image") == {"jpg", "avif"} and by("audio") == {"mp3", "aif", "opus"} and by("video") == {"mp4", "3gp", "wmv"}
    assert by("spreadsheet") == {"xlsx", "csv"} and by("presentation") == {"pptx"} and by("code") == {"py", "rtf"} and by("email") == {"msg"}


def test_admission(spark):
    paths = ["/r/a.txt", "/r/AppData/b.txt", "/r/tool/unins000.exe", "/r/tool/sub/c.md", "/r/rust/lib/rustlib/x/y.md", "/r/rust/z.md", "/r/package-lock.json", "/r/x.min.js", "/r/.h.txt", "/r/i.jpg"]
    listing = spark.createDataFrame([(p, 10) for p in paths], "path string, size long")
    got = {r.path: r.skip for r in scan.admitted(listing, "/r").collect()}
    assert got == dict(zip(paths, [None, "folder", "installed software", "installed software", "installed software", "installed software", "name", "name", "hidden", "type"], strict=True))


def test_token_chunks_always_move_on(spark):
    docs = spark.createDataFrame([(1, "aaaa " * 10 + "b" * 50)], "doc_id long, text string")
    rows = transcripts.token_chunks(docs, len, 20, 8).orderBy("chunk_index").collect()
    starts = [r.start_offset for r in rows]
    assert starts == sorted(set(starts)) and rows[-1].end_offset == 100


@pytest.mark.parametrize("question, expected", [
    ("How many PDFs do I have?", ("count", ["pdf"])),
    ("hw many vidoes are there", ("count", ["video"])),
    ("so, can you list the 3 newest e-mails", ("list", ["email"])),
    ("any voice notes?", ("any", ["audio"])),
    ("how many word documents", ("count", ["word"])),
    ("how many photos and movies did I save", ("count", ["image", "video"])),
    ("how many files are indexed on this computer", ("count", [])),
    ("what is the total number of files", ("count", [])),
    ("how many quizzes do i have", ("count", [])),
    ("how many people came to the party", None),
    ("what does the report say about rivers", None),
    ("summarise my notes", None),
])
def test_questions(spark, question, expected):
    got = questions.parse(question)
    assert (got and (got.mode, got.kinds)) == expected


def test_question_times(spark):
    now = 1706659200.0  # 2024-01-31, a Wednesday
    window = lambda q: (lambda r: (r.since, r.until))(questions.parse(q, now))
    assert window("how many files in the last 2 hours") == (now - 7200, None)
    assert window("how many files in the last hr") == (now - 3600, None)
    assert window("list files from last week") == (1705881600.0, 1706486400.0)
    assert window("how many photos last month") == (1701388800.0, 1704067200.0)
    assert window("which files were added yesterday") == (now - 86400, now)
    assert window("which files since yesterday") == (now - 86400, None)
    assert window("show recent files") == (now - 7 * 86400, None)
    assert questions.parse("how many quizzes do i have").name_word == "quizze"


def test_large_sessions_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(behaviour, "SESSION_BLOCK", 7)
    events = [(k, u, float(k), "file_opened", (k * 7 + u) % n) for u, n in ((1, 40), (2, 3)) for k in range(60)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, ts double, kind string, doc_id long")
    active = spark.range(38).withColumnRenamed("id", "doc_id")
    want = {(u, a, b, 1) for u, n in ((1, 38), (2, 3)) for a in range(n) for b in range(n) if a != b}
    assert set(map(tuple, behaviour.cooccurrence(frame, active).collect())) == want
    assert set(map(tuple, behaviour.cooccurrence(frame, active, most=20).collect())) == {w for w in want if w[0] == 2}


def test_spelling_candidates_stand_near_their_place(spark):
    """All pairs within the edits are candidates, but no term that has a piece of a word elsewhere, or another length."""
    import random

    rng = random.Random(4)
    random_word = lambda a, b: "".join(rng.choices("abc", k=rng.randint(a, b)))
    words = sorted({random_word(6, 9) for _ in range(40)})
    terms = sorted({random_word(3, 16) for _ in range(1500)} | {w + "ab" for w in words} | {w[:-2] for w in words})
    asked, vocab = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, 1) for t in terms], "term string, occurrences long")
    got = {(r.word, r.term) for r in names.within_edits(asked, vocab).collect()}

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line = line, [i]
            for j, y in enumerate(b, 1):
                line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        return line[-1]

    close = {(w, t) for w in words for t in terms if abs(len(w) - len(t)) <= 2 and (edits(w, t) <= (2 if len(w) >= 7 else 1) or ((w.startswith(t) or t.startswith(w)) and abs(len(w) - len(t)) <= 2))}
    assert close <= got
    assert all(abs(len(w) - len(t)) <= 2 for w, t in got)
    far = names.within_edits(spark.createDataFrame([("abcdefg",)], "word string"), spark.createDataFrame([("zzzzzabzz", 1), ("abzzzzzzzzzz", 1), ("abcdefgh", 1)], "term string, occurrences long"))
    assert [r.term for r in far.collect()] == ["abcdefgh"]
