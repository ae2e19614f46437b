"""Queries on hand-made tables with what the sample tables lack, against their SQL."""

import duckdb
import pytest

from heliograph.plans import catalogue
from tests.test_oracle import plain


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query on these tables equals its SQL; gives the rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        frame = catalogue.QUERIES[name](spark, str(tmp_path))
        columns = sorted(frame.columns)
        rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
        cursor = con.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
        assert str(rows) == str(expected)  # as text: NaN is no equal of itself
        return rows

    return check


def documents(spark, *texts):
    rows = [(i, t, "s", "en", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")


def benchmark(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_passages_of_short_words_only(spark, same):
    """Neither of two such passages has a word to compare."""
    rows = same("jaccard_near_dupes", documents=documents(spark, "ab cd ef", "cd ab", "ab cd longer words", "ab cd longer words here"), benchmark=benchmark(spark, "ab cd ef gh ij"))
    assert "nan" in str(rows)


def vectors(spark, n, width=2):
    rows = [(i, [float(i * (k + 1) % 7) / 7 for k in range(width)], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_every_file_by_its_best_frame(spark, same):
    """Also those without a frame among the hundred nearest; the frames of a file tie."""
    assert len(same("visual_best_per_file", embeddings=vectors(spark, 202))) == 5 * 51


def test_words_of_a_file_whose_best_passage_has_no_text(spark, same):
    """The first file is known by its words, and by a vector of a passage that isn't there, which is nearest."""
    v = spark.createDataFrame([(i, [0.0 if i in (2, 3) else 2.0 + i], 0) for i in range(12)], "vec_id long, embedding array<float>, label int")
    rows = same("match_explanation", documents=documents(spark, "alpha beta", "alpha beta gamma", "gamma"), benchmark=benchmark(spark, "alpha beta gamma delta epsilon"), embeddings=v)
    assert any("Contains: " in row for row in rows)
