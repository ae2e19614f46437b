"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources.tables import removed as remove
from heliograph.sources.tables import shared_folder as shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage: what is read later doesn't depend on any executor's local disk. file_rows: rows of a file at most, for
    large values, as Spark's reader holds the values of some thousand rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() has written for these, once nothing will read them again."""
    for df in frames:
        remove(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over; it does so once the driver's garbage is collected,
    which may otherwise be long after a large exchange has been written out."""
    gc.collect()
    spark._jvm.System.gc()


def private(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with its columns named by their places, but for those that an operator works on, so that no other can clash
    with a name that it uses within; restored() gives the names back."""
    return docs.toDF(*(name if name in kept else f"_{k}" for k, name in enumerate(docs.columns)))


def restored(rows: DataFrame, docs: DataFrame, *kept: str, **more: str) -> DataFrame:
    """The columns of docs from rows of private(docs); more: other columns of rows that replace or follow these, by their new names."""
    own = [(name if name in kept else f"_{k}", name) for k, name in enumerate(docs.columns)]
    out = [F.col(more.get(name, held)).alias(name) for held, name in own]
    return rows.select(*out, *(F.col(held).alias(name) for name, held in more.items() if name not in docs.columns))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The texts of a batch as UTF-8, without making Python strings."""
    array = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    for value in array.cast(kind):
        yield value.as_py()
