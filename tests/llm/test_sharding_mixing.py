import zlib

import pytest
from pyspark.sql import functions as F

from heliograph.llm import mixing, sharding
from tests.llm.helpers import DOCS, clashing, docs, rows


def test_shards_are_contiguous_and_even(spark):
    data = [(i * 7 % 400, "x" * (i * 13 % 90), "en", "a", 1) for i in range(400)]
    got = sharding.contiguous_shards(docs(spark, data)).orderBy("doc_id").collect()
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    size = {s: sum(r.size for r in got if r.shard == s) for s in range(8)}
    assert max(size.values()) - min(size.values()) <= 2 * 91
    for s in range(8):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_shards_of_odd_rows(spark):
    got = sharding.contiguous_shards(clashing(docs(spark))).collect()
    assert len(got) == len(rows())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows()}
    full = sharding.with_shards(docs(spark)).collect()
    assert len(full) == len(rows()) and all(0 <= r.shard < 8 for r in full)
    empty = docs(spark, [])
    assert sharding.contiguous_shards(empty).count() == 0 and sharding.with_shards(empty).count() == 0


def test_one_row_many_times_is_cut(spark):
    data = [(5, "the same", "en", "a", 1)] * 10_000 + [(k, "x" * k, "en", "a", 1) for k in range(100)]
    got = sharding.contiguous_shards(docs(spark, data).repartition(5)).collect()
    sizes = [9] * 10_000 + [k + 1 for k in range(100)]
    by = {s: [r for r in got if r.shard == s] for s in range(8)}
    assert sorted(r["size"] for r in got) == sorted(sizes)
    assert all(abs(sum(r["size"] for r in own) - sum(sizes) / 8) <= 110 and sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshares what is above the limits until nothing is."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, {}
    while True:
        rest = total - sum(fixed.values())
        open_ = [n for n in names if n not in fixed]
        target = fixed | {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        above = [n for n in open_ if target[n] > most * sizes[n] + 1e-9]
        if not above:
            return target
        fixed |= {n: most * sizes[n] for n in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1, "b": 1}, {"x": 0, "y": 7}, {"b": 4, "é": 90, "z": 1, "a": 2, "": 3}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_comes_near_targets_and_is_stable(spark):
    data = [(i, "w " * (i * 37 % 50 + 1), "en", f"s{i % 7 if i % 3 else 0}", 1) for i in range(3000)]
    frame = docs(spark, data)
    got = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r.row.doc_id, r.copies) for r in got) == sorted((r.row.doc_id, r.copies) for r in again)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.row.source] = taken.get(r.row.source, 0) + r.copies * r.size
        target[r.row.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], abs=4)
    assert mixing.mixed(frame).count() == sum(r.copies for r in got)


def test_a_few_long_documents_do_not_spoil_the_mix(spark):
    data = [(i, "w " * (20_000 if i % 500 == 3 else i * 37 % 300 + 1), "en", f"s{i % 4}", 1) for i in range(2000)]
    taken, target = {}, {}
    for r in mixing.mix(docs(spark, data)).collect():
        taken[r.row.source] = taken.get(r.row.source, 0) + r.copies * r.size
        target[r.row.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in target)


def test_mix_equals_its_sql(spark, tmp_path):
    import duckdb

    data = [(i, "w " * (i * i % 700), "en", [None, "", "a", "b", "é"][i % 5], 1) for i in range(900)] + [(9000, None, "en", "a", 1), (9001, "x " * 9000, "en", "b", 1)]
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.op9_mixing(spark, str(tmp_path)).collect())
    assert got == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.OP9_SQL).fetchall())


def brute_shards(data, shards=8):
    """Rows in order, bytes before each, cut at equal targets."""
    slim = sorted(((d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in data)
    total, before, out, slots = sum(s[2] for s in slim), 0, [], [0] * shards
    for (known, d), crc, size in slim:
        shard = before * shards // total
        out.append((d if known else None, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shards_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    data = rows() + [(rng.choice([None, *range(-50, 300)]), rng.choice([None, "", "é" * rng.randint(1, 400), "x" * rng.randint(1, 90)]), "en", "a", 1) for _ in range(rng.choice([0, 3, 500]))]
    got = [tuple(r) for r in sharding.contiguous_shards(docs(spark, data)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_shards(data)))


def test_mix_of_odd_rows(spark):
    assert mixing.mix(docs(spark)).count() == len(rows())
    assert mixing.mixed(clashing(docs(spark))).columns == clashing(docs(spark)).columns
    assert mixing.mix(docs(spark, [])).count() == 0
    nothing = mixing.mix(docs(spark, [(1, None, "en", "a", 1), (2, "", "en", None, 1)])).collect()
    assert [r.copies * r.size for r in nothing] == [0, 0]


def test_words_are_split_by_ascii_space(spark):
    frame = spark.createDataFrame([("a b c\u000bd\te",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(mixing.words(F.col("t"))).collect()] == [4, 0, 0]
    assert DOCS
