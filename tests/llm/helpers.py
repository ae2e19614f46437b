"""Inputs that every operator has to stand."""

from heliograph.llm.common import materialise  # noqa: F401  the subpackage under test

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Nulls in each column, empty and long texts, ties and repeated rows."""
    prose = "the cat sat on the mat and the dog ran to the old house by the river "
    return [
        (1, prose * 3, "en", "a", 1),
        (2, prose * 3, "en", "b", 1),
        (2, prose * 3, "en", "b", 1),
        (2, "another text with one id " * 4, "en", "b", 1),
        (3, "", "en", "a", 0),
        (4, None, "en", None, None),
        (None, "no id here but words " * 5, None, "a", 1),
        (None, None, None, None, None),
        (5, "x " * 40_000, "xx", "c", 1),
        (6, "w" * 200_000, "xx", "c", 1),
        (7, "le chat est sur la maison et le chien court vers la rivière " * 4, "fr", "a", 1),
        (8, "...   \n\t 12 34", "fr", "", 1),
        (-9, "ünï ✓ 漢字 𝄞 text", "fr", "é", 1),
    ]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def clashing(frame):
    """With further columns whose names operators use within."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "part", "mark", "score", "lang_pred", "_key", "_n", "key", "kind", "blob", "fp", "node", "component", "target", "spans", "n", "count")
    return frame.select("*", *(F.lit("clash").alias(n) for n in names))
