"""A library in a folder: records and a keyword index that follow the folders they were made from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.config import NOW
from heliograph.fixtures import chunk_words
from heliograph.functions.text import extension
from heliograph.operators.index import KeywordIndex
from heliograph.operators.lifecycle import retention, snapshot_diff
from heliograph.operators.store import copied_chunks
from heliograph.sources.extract import extract
from heliograph.sources.scan import admitted, chunk_cap, read_files
from heliograph.sources.tables import written

RECORDS = "doc_id long, file_id string, path string, ext string, size long, modified_time double, hash string, deleted boolean, indexed boolean, error string, audio_only boolean"
CHUNKS = "chunk_id string, doc_id long, chunk_index long, content string"
LOG = "file_id string, path string, deleted_at double"


def under(root: str) -> Column:
    """Whether a path lies under a folder."""
    return F.lower("path").startswith(root.rstrip("/").lower() + "/")


@dataclass
class Library:
    """Versions of records, of the deletion log and of the index; each call gives the next one, and the one before stays
    readable. A file keeps its doc_id when it is renamed."""

    spark: SparkSession
    folder: str
    version: int
    index: KeywordIndex

    @classmethod
    def create(cls, spark: SparkSession, folder: str, model: str = "") -> Library:
        folder = folder.rstrip("/")
        spark.createDataFrame([], RECORDS).write.parquet(f"{folder}/records-1")
        spark.createDataFrame([], LOG).write.parquet(f"{folder}/log-1")
        return cls(spark, folder, 1, KeywordIndex.create(f"{folder}/index", spark.createDataFrame([], CHUNKS), model))

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORDS).parquet(f"{self.folder}/records-{self.version}")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log-{self.version}")

    def _next(self, records: DataFrame, log: DataFrame, index: KeywordIndex) -> Library:
        """The index is written by now, so that a record never says indexed before its chunks can be found."""
        names = [f.split()[0] for f in RECORDS.split(", ")]
        records.select(*names).write.mode("overwrite").parquet(f"{self.folder}/records-{self.version + 1}")
        log.write.mode("overwrite").parquet(f"{self.folder}/log-{self.version + 1}")
        return Library(self.spark, self.folder, self.version + 1, index)

    def index_folder(self, root: str, now: float = NOW) -> tuple[Library, DataFrame]:
        """The library after a scan of a folder, and status and n of what was found: new, modified, renamed, unchanged,
        deleted files, and those skipped, by reason.

        Content is hashed where it is read. New and changed files are extracted and chunked, unless an indexed file has
        the same content, whose chunks are copied; their old chunks are replaced last. A file that can't be read is told
        in its record and has no chunks; it isn't tried again until its bytes change.
        """
        found = read_files(self.spark, root)
        listing = admitted(found.select("path", "size"), root.rstrip("/")).select("path", "skip")
        skipped = listing.where("skip is not null").groupBy(F.concat(F.lit("skipped: "), "skip").alias("status")).agg(F.count("*").alias("n"))
        hashed = written(found.join(listing.where("skip is null").select("path"), "path", "left_semi").select("path", "size", F.unix_micros("modified").alias("at"), F.sha2("content", 256).alias("hash")))
        before = written(self.records())
        live, other = before.where(~F.col("deleted") & under(root)), before.where(F.col("deleted") | ~under(root))
        diff = written(snapshot_diff(live.select("path", "hash"), hashed.select("path", "hash")))

        fresh = hashed.join(diff.select("path", "status"), "path")
        old = live.select(F.col("path").alias("old_path"), "doc_id", "file_id", "indexed", "error", F.col("hash").alias("old_hash"))
        same = fresh.where("status in ('unchanged', 'modified')").join(old, F.col("path") == F.col("old_path"))
        # a renamed file takes over a record whose path is gone and whose content it has; equal contents in order of paths
        number = lambda df, by: df.withColumn("k", F.row_number().over(_line(by)))
        gone = old.join(diff.where("status = 'deleted'").select(F.col("path").alias("old_path")), "old_path", "left_anti").join(hashed.select(F.col("path").alias("old_path")), "old_path", "left_anti")
        moved = number(fresh.where("status = 'renamed'"), "path").join(number(gone.withColumnRenamed("old_hash", "hash"), "old_path"), ["hash", "k"])
        made = fresh.where("status = 'new'").select("path", "size", "at", "hash", "status", F.xxhash64("path", F.lit(now)).alias("doc_id"))
        made = made.withColumns({"file_id": F.col("doc_id").cast("string"), "indexed": F.lit(False), "error": F.lit(None).cast("string")})
        columns = ["path", "size", "at", "hash", "status", "doc_id", "file_id", "indexed", "error"]
        now_there = written(same.select(columns).unionByName(moved.select(columns)).unionByName(made.select(columns)))

        changed = now_there.where("status in ('new', 'modified')")
        donors = self._donors(other.unionByName(live.join(diff.where("status = 'unchanged'").select("path"), "path", "left_semi")))
        reuse = written(changed.join(donors, "hash").select("doc_id", "reuse_from"))
        read = changed.join(reuse, "doc_id", "left_anti").select("path", "doc_id")
        blocks = written(extract(found.join(read, "path", "left_semi").select("path", "content")).join(read, "path"))
        failed = blocks.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("failure"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n\n")
        whole = blocks.where("error is null and text is not null").groupBy("doc_id", "path").agg(text.alias("text"))
        most = F.coalesce(chunk_cap(F.col("ext")).cast("long"), F.lit(1 << 40))
        new_chunks = chunk_words(whole.select("doc_id", "text")).join(whole.select("doc_id", extension("path").alias("ext")), "doc_id").where(F.col("chunk_index") < most).select("chunk_id", "doc_id", "chunk_index", "content")
        lost = live.join(diff.where("status = 'deleted'").select("path"), "path", "left_semi")
        copies = copied_chunks(self.index.chunks(), reuse)
        index = self.index.replace(changed.select("doc_id").unionByName(lost.select("doc_id")), new_chunks.unionByName(copies))

        done = now_there.join(failed, "doc_id", "left").select(
            "doc_id", "file_id", "path", extension("path").alias("ext"), "size", (F.col("at") / 1e6).alias("modified_time"), "hash", F.lit(False).alias("deleted"),
            F.when(F.col("status").isin("new", "modified"), F.col("failure").isNull()).otherwise(F.col("indexed")).alias("indexed"),
            F.when(F.col("status").isin("new", "modified"), F.col("failure")).otherwise(F.col("error")).alias("error"), F.lit(None).cast("boolean").alias("audio_only"),
        )
        log = retention(self.log().unionByName(lost.select("file_id", "path", F.lit(now).alias("deleted_at"))), now)
        report = diff.groupBy("status").agg(F.count("*").alias("n")).unionByName(skipped)
        return self._next(other.unionByName(done).unionByName(lost.withColumn("deleted", F.lit(True))), log, index), report

    @staticmethod
    def _donors(records: DataFrame) -> DataFrame:
        """hash and the smallest indexed, live file that has it."""
        return records.where("indexed and not deleted").groupBy("hash").agg(F.min("doc_id").alias("reuse_from"))

    def forget_folder(self, root: str) -> Library:
        """Without the files under a folder and their chunks; this isn't a deletion, so the log doesn't tell it."""
        before = self.records()
        index = self.index.delete(before.where(under(root)).select("doc_id"))
        return self._next(before.where(~under(root)), self.log(), index)

    def reindex_folder(self, root: str, now: float = NOW) -> tuple[Library, DataFrame]:
        return self.forget_folder(root).index_folder(root, now)

    def purge(self) -> Library:
        """Without tombstones; the index is compacted."""
        before = self.records()
        return self._next(before.where("not deleted"), self.log(), self.index.purge(before))

    def status(self) -> DataFrame:
        """Files, indexed, failed and deleted, and chunks."""
        n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
        by = self.records().agg(n(~F.col("deleted")).alias("files"), n(F.col("indexed") & ~F.col("deleted")).alias("indexed"), n(F.col("error").isNotNull() & ~F.col("deleted")).alias("failed"), n(F.col("deleted")).alias("deleted"))
        return by.join(F.broadcast(self.index.chunks().agg(F.count("*").alias("chunks"))))  # one row each


def _line(by: str):
    from pyspark.sql import Window

    return Window.partitionBy("hash").orderBy(by)
