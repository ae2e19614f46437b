"""Erasure against the same done with sorted lists, file by file."""

import hashlib
import math
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from heliograph.llm import erasure
from heliograph.llm.common import table

TABLES = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def ordered(value):
    return (0,) if value is None else (2,) if value != value else (1, value)


def brute(data):
    """data: columns and rows of each table. What the query says of each final file, without its path, and the rows."""
    at = {name: {c: k for k, c in enumerate(columns)} for name, (columns, _) in data.items()}
    of = lambda name, row, column: row[at[name][column]]
    owner = {}
    for row in data["sales"][1]:
        sale, client = of("sales", row, "sale_id"), of("sales", row, "client_id")
        if sale is not None:
            owner[sale] = min((c for c in (owner.get(sale), client) if c is not None), default=None)
    clicks = Counter(of("clicks", r, "client_id") for r in data["clicks"][1])
    of_master = {}
    for row in data["clients"][1]:
        if of("clients", row, "master_id") is not None:
            of_master.setdefault(of("clients", row, "master_id"), set()).add(of("clients", row, "client_id"))
    victims = {m for m in of_master if crc(m) % 200 == 0}
    victims |= set(sorted(of_master, key=lambda m: (-sum(clicks[c] for c in of_master[m] if c is not None), m))[:1])
    clients = {of("clients", r, "client_id") for r in data["clients"][1] if of("clients", r, "master_id") in victims} - {None}
    sales = {of("sales", r, "sale_id") for r in data["sales"][1] if of("sales", r, "client_id") in clients} - {None}
    linked = {"clients": ("master_id", victims), "clicks": ("client_id", clients), "sales": ("client_id", clients), "sale_lines": ("sale_id", sales)}
    out, kept = [], {}
    for name, (columns, rows) in data.items():
        client = (lambda r: owner.get(of("sale_lines", r, "sale_id"))) if name == "sale_lines" else (lambda r, name=name: of(name, r, "client_id"))
        rows = sorted(rows, key=lambda r: (crc(client(r)), *map(ordered, r)))
        size = 1 + len(rows) // 250
        column, values = linked[name]
        for k in range(0, len(rows), size):
            own = [r for r in rows[k : k + size] if of(name, r, column) not in values]
            erased = len(rows[k : k + size]) - len(own)
            if own:
                cents = sum(math.floor(100 * v + 0.5) for r in own if (v := of(name, r, TABLES[name])) is not None and math.isfinite(v))
                ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in own).encode()).hexdigest()
                out.append((k // size, len(own), erased, cents, erased > 0, name, ids, ",".join(columns)))
                kept[name, k // size] = own
    return sorted(out), kept


def held(spark, folder):
    return {name: ((frame := table(spark, folder, name)).columns, [tuple(r) for r in frame.collect()]) for name in TABLES}


def same(got, want):
    """Rows as read from Parquet against rows as collected; NaN equals NaN."""
    return repr([tuple(r) for r in got]) == repr(want)


def compare(spark, folder):
    info = erasure.op11_erasure(spark, folder).collect()
    want, kept = brute(held(spark, folder))
    assert sorted(tuple(r)[:-1] for r in info) == want
    for r in info:
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        assert same(zip(*file.read().to_pydict().values(), strict=True), kept[r.table_name, r.file_no])
        ids = [row[0] for row in kept[r.table_name, r.file_no] if row[0] is not None]
        groups = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        assert (min(g.min for g in groups if g.has_min_max), max(g.max for g in groups if g.has_min_max)) == (min(ids), max(ids)) if ids else True
    root = info[0].path.removeprefix("file:").rsplit("/", 2)[0] if info else None
    if root:
        import os

        there = {f"{d}/{f}" for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}
        assert there == {r.path.removeprefix("file:") for r in info}
    return info


def test_query(spark):
    info = compare(spark, "/root/testdata/sf0.001")
    assert {r.table_name for r in info} == set(TABLES) and {r.rewritten for r in info} == {True, False}


def shop(spark, folder, clients, clicks, sales, lines):
    day = datetime(2024, 1, 1)
    moment = lambda k: None if k is None else day + timedelta(seconds=k)
    kinds = {
        "clients": ("client_id long, master_id long, updated_at timestamp_ntz, name string, balance double, size boolean", [(c, m, moment(c), n, b, None) for c, m, n, b in clients]),
        "clicks": ("click_id long, ts timestamp_ntz, client_id long, value double, `order` string, `a.b` date", [(i, moment(t), c, v, "clash", day.date()) for i, t, c, v in clicks]),
        "sales": ("sale_id long, client_id long, total double, `row` binary", [(s, c, t, b"x") for s, c, t in sales]),
        "sale_lines": ("sale_id long, line_no int, amount double, _sale string, _owner string", [(s, n, a, None, "") for s, n, a in lines]),
    }
    for name, (schema, rows) in kinds.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_nulls_ties_repeats_and_names(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    clients = [(c, None if c % 7 == 0 else c % 5, n, b) for c, n, b in zip(range(40), [None, "", "é", "漢", "a", "+", "𝄞", "￿"] * 5, [None, nan, -0.5, inf, -inf, 12.345, 0.005, 1e9] * 5, strict=True)]
    clients += [(None, 2, "x", 1.0), (None, None, None, None), (3, 3, "again", 2.0), (3, 4, "other", 2.0)]
    clicks = [(None if k % 11 == 0 else k // 2, k % 3 or None, None if k % 5 == 0 else k % 43, [1.0, None, nan, 0.125][k % 4]) for k in range(700)]
    clicks += [(1, 1, 4, 1.0)] * 900  # one row repeated over several files
    sales = [(None if k % 13 == 0 else k, None if k % 6 == 0 else k % 41, k / 8) for k in range(300)] + [(5, 1, 1.0), (5, 40, 1.0), (5, None, 2.0)]
    lines = [(None if k % 17 == 0 else k % 320, k % 4 or None, k / 3) for k in range(1000)] + [(8, 1, 1.0)] * 600
    shop(spark, tmp_path, clients, clicks, sales, lines)
    compare(spark, str(tmp_path))


def test_empty_tables(spark, tmp_path):
    shop(spark, tmp_path, [(1, 1, "a", 1.0)], [], [], [])
    assert compare(spark, str(tmp_path)) == []
    shop(spark, tmp_path / "b", [], [(1, 1, 2, 1.0)], [], [(1, 1, 1.0)])
    assert [(r.table_name, r.n_rows) for r in compare(spark, str(tmp_path / "b"))] == [("clicks", 1), ("sale_lines", 1)]


def test_all_of_a_file_goes_and_others_stay_as_they_are(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 10).alias("group"), "id")
    written = erasure.write_ordered(rows, F.col("group"), "t", f"{erasure.shared_dir(spark)}/{tmp_path.name}", "group")
    assert [f[1] for f in written.files] == [5] * 200
    final, ids = erasure.rewrite(written, spark.sparkContext.parallelize([3, 3, 8, 77]), "id")
    assert sorted(ids.collect()) == [k for k in range(1000) if k % 10 in (3, 8)]
    info = erasure.settle(written, final)
    assert erasure.settle(written, final) == info  # again changes nothing
    assert [f[0] for f in info] == [k for k in range(200) if k // 20 not in (3, 8)]
    assert sum(pq.ParquetFile(f[-1].removeprefix("file:")).metadata.num_rows for f in info) == 800


def test_a_task_may_run_again(spark, tmp_path):
    folder = f"{tmp_path}/t"
    import pyarrow as pa

    batch = pa.record_batch({"a": [1, None, 3]})
    for _ in range(2):
        file = erasure._File(folder, "file-00000.parquet", batch.schema, None)
        file.add(batch)
        file.close()
    assert pq.read_table(f"{folder}/file-00000.parquet").to_pydict() == {"a": [1, None, 3]}
    assert file.ids.hexdigest() == hashlib.sha256(b"1,,3").hexdigest()


def test_a_reader_of_waiting_rows_holds_few_blocks(spark, tmp_path, monkeypatch):
    """However many rows a task has written: Spark's reader holds all of a file's blocks, up to some thousand, at once."""
    seen = []

    def look(frame):
        seen.extend(pq.ParquetFile(f).metadata.num_rows for f in tmp_path.glob(f"{frame._written_to.rpartition('/')[2]}/*.parquet"))

    monkeypatch.setattr(erasure, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr("heliograph.llm.common.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(erasure, "discard", look)
    written = erasure.write_ordered(spark.range(200_000, numPartitions=1), F.col("id"), "t", f"{tmp_path}/out", "id")
    assert sum(f[1] for f in written.files) == 200_000
    assert sum(seen) >= 200_000 / erasure.BLOCK_ROWS and max(seen) <= 32


def test_blocks_of_wide_rows_are_small():
    import pyarrow as pa

    batch = pa.record_batch({"a": ["x" * 300_000] * 50})
    out = list(erasure._tuples(iter([batch])))
    assert sum(sum(b.column(0).to_pylist()) for b in out) == 50 and max(b.nbytes for b in out) < 2 << 20
    assert list(erasure._tuples(iter([batch.slice(0, 0)]))) == []
