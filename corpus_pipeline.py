"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage takes documents with any further columns, whatever their names, and returns the same columns (the last one a
shard besides). Nulls may stand in any column; texts may be empty or very long; doc_ids may be tied, rows repeated and
the table empty, which gives an empty table. What each stage does with these is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm.common import materialise, private, restored, table
from heliograph.llm.decontaminate import clean
from heliograph.llm.language import fit, identify
from heliograph.llm.mixing import mixed
from heliograph.llm.nearcopies import keep_one
from heliograph.llm.sharding import with_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; lang becomes the predicted one. A text that is null, empty or
    without a letter has no language and goes; so does every document if none has a label to learn from. Equal rows
    share their fate. Very long texts are scored as a whole."""
    rows = private(docs, "text")
    found = identify(rows, fit(docs), carry=tuple(rows.columns)).where("accepted")
    return restored(found, docs, "text", lang="lang_pred")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, Jaccard similarity of 0.8 or more): the
    smallest doc_id, a null one last; of repeated rows one. Null and empty texts are copies of each other."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none and stays; repeated rows share their
    fate; null and empty items are in no document."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times. Null sources are one source; a source without
    words, so one of null and empty texts, gives none. Repeated rows and equal doc_ids count as documents of their own."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the number of their shard. A null text counts one byte, a null doc_id comes first; rows with equal
    doc_id and text are in one shard."""
    return with_shards(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
    ("sharding", sharding),
]

#: Language models, fingerprints and tilings have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
