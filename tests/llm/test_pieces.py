"""Pieces against the library that reads the same model."""

import hashlib
import random
import sys

import pyarrow as pa
import pytest
import sentencepiece

from heliograph.llm import pieces
from tests.llm.helpers import clashing, docs


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.model(pieces.default_model())


def ids(own, text):
    return list(memoryview(own.encode(text)).cast("i")) if text else []


HARD = ["", " ", "  ", "   " * 33, "\n", "a\tb\r\nc", "▁", "▁▁ x ▁", "www www.", "<s></s><unk><0x0A>", "a\x00b", "ﬁ é é", "漢字 𝄞 ✓", "　x", "�", "1234567890" * 5, "aaaaaaaaab" * 9]


def test_every_text_is_encoded_as_the_library_does(own, library):
    chance = random.Random(3)
    parts = [*"abeéß漢𝄞01 \n\t▁<_-\x00", "  ", "the", "ww", "er", "s>", "    ", "ing ", "́"]
    texts = HARD + ["".join(chance.choices(parts, k=chance.randrange(60))) for _ in range(3000)]
    for text in texts:
        got = ids(own, text)
        assert got == library.encode(text), text
        assert own.decode(got) == library.decode(got), text


def test_any_ids_are_decoded_as_the_library_does(own, library):
    chance = random.Random(4)
    for _ in range(5000):
        some = [chance.choice([chance.randrange(32_000), chance.randrange(262)]) for _ in range(chance.randrange(8))]
        assert own.decode(some) == library.decode(some), some


def test_pairs_are_compatible_as_by_joining(own):
    chance = random.Random(5)
    usual = list(own.left)
    for group in (usual, [k for k in usual if set(own.text[k]) <= set("w▁th")], usual[:500]):
        for _ in range(4000):
            a, b = chance.choice(group), chance.choice(group)
            assert own.compatible(a, b) == (own.joined(own.text[a] + own.text[b]) == [own.text[a], own.text[b]])


def test_each_prefix_has_the_last_piece_of_its_encoding(own):
    for text in ("▁unbelievable", "▁▁▁▁▁▁▁", "wwwwwww", "x漢y"):
        for n, last in enumerate(own.table(text), 1):
            parts = own.joined(text[:n])
            assert (own.text[last] if last >= 0 else parts[-1]) == parts[-1]


def test_long_texts_take_time_in_proportion(own, library):
    for text in ("w" * 100_000, " " * 50_001, "ab" * 50_000):
        assert ids(own, text) == library.encode(text)


def test_rows_of_any_kind(spark, library):
    frame = clashing(docs(spark))
    got = pieces.decode(pieces.encode(frame)).collect()
    want = [(r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in frame.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pieces.decode(pieces.encode(docs(spark, []))).count() == 0


def test_both_ways_by_one_worker(spark):
    plan = pieces.op12_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each has a Python worker of its own in every task
    frame = clashing(docs(spark))
    both = pieces.encode_and_decode(frame)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, pieces.decode(pieces.encode(frame)).collect()))


def test_batches_are_small_however_long_texts_are(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 100)
    texts = [None, "", "some words " * 40, "", "x"] * 30 + ["a long text of many words " * 900, None] + HARD * 3
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    want = [(k, w, library.decode(w)) for k, w in enumerate(library.encode(t or "") for t in texts)]
    encoded = list(pieces._encoded(iter([rows, rows[:0]]), own))
    whole = pa.Table.from_batches(encoded).combine_chunks().to_batches()
    for got in (pieces._decoded(iter(encoded), own), pieces._decoded(iter(whole), own)):
        got = list(got)
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
        for batch in got:
            sizes = list(map(len, batch.column(1).to_pylist()))
            assert sum(sizes) - max(sizes) <= 100
    assert len(encoded) > 10


def test_words_of_any_script_are_held_within_bytes(library, monkeypatch):
    monkeypatch.setattr(pieces, "WORD_BYTES", 1 << 16)
    own, chance = pieces.Pieces(open(pieces.default_model(), "rb").read()), random.Random(6)
    for _ in range(300):
        text = " ".join("".join(chance.choices("漢字文書検索語彙結合", k=50)) for _ in range(5))
        assert ids(own, text) == library.encode(text)
        assert sum(sys.getsizeof(w) + sys.getsizeof(k) for w, k in own.words.items()) <= 1 << 16
    assert own.words


def test_null_ids_are_as_none(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (None, [300, 400])], "doc_id long, ids array<int>")
    assert [r.decoded == "" for r in pieces.decode(rows).collect()] == [True, True, False]


def test_query(spark, library):
    from heliograph.llm.common import table

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in table(spark, sf, "documents").collect():
        own = library.encode(r.text or "")
        want[r.doc_id] = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode(own).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in pieces.op12_pieces(spark, sf).collect()} == want


def test_other_models_are_refused(tmp_path):
    data = open(pieces.default_model(), "rb").read()
    with pytest.raises(ValueError):
        pieces.Pieces(data + b"\x1a\x02\x20\x01")  # a normaliser that removes spaces
