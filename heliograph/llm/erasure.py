"""Cascading erasure: tables are written in one order as numbered files, and the files that hold victims are rewritten.

1. Rows become tuples that compare as their columns do, nulls first. RDD.sortBy orders them by the whole tuple, so that
   a key with very many rows is dealt out by its further columns; zipWithIndex ranks them.
2. Ranked rows are packed into blocks, and a partitioner sends each file number's blocks to one task, sorted by rank as a
   stream, into one pyarrow writer. Besides its file a task tells which values of the linked column stand in it.
3. Erasure goes from table to table by cogrouped links: victims' values meet the files that hold them, folded to one
   entry for each value and file before the exchange; each file number goes to one writer again, which keeps the
   survivors in order and hands on the keys of what it has erased, the victims of the next table.

Files are written beside the final folder and moved into it whole, under names that only depend on the file's number and
on whether it is rewritten, so a task can run again at any time; first files are only deleted once all jobs are over.
"""

from __future__ import annotations

import atexit
import hashlib
import itertools
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise, release, remove, shared_dir, table

#: A table of n rows is written as files of 1 + floor(n / FILES) rows, so there are FILES files at most.
FILES = 250
#: Rows of a partition that is sorted, and these partitions at most; larger ones spill.
SORTED_ROWS, SORTED_PARTS = 1 << 16, 20_000
#: Rows that travel and are written at once; of wide rows so many as have these bytes.
BLOCK_ROWS, BLOCK_BYTES = 1 << 12, 1 << 20
#: Blocks in a file of rows that wait to be sorted: a task that reads them holds a file's blocks at once.
FILE_BLOCKS = 32
#: A block of link values for each partition.
LINK_ROWS = 1 << 17
LOW = float("-inf")

INFO = "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, table_name string, ids_sha256 string, columns string, path string"


def comparable(array: pa.Array) -> list:
    """Values that compare as the column does, nulls first: a null number is below all numbers, strings get a mark before them, and
    floating-point numbers stand in tuples, empty ones for nulls and the greatest for NaN, as a null is none of them."""
    kind = array.type
    if pa.types.is_floating(kind):
        return [() if v is None else (v,) if v == v else (float("inf"), 0) for v in array.to_pylist()]
    if pa.types.is_string(kind):
        return ["" if v is None else f"+{v}" for v in array.to_pylist()]
    if pa.types.is_binary(kind):
        return [b"" if v is None else b"+" + v for v in array.to_pylist()]
    if pa.types.is_date(kind):
        array = array.cast(pa.int32())
    elif pa.types.is_timestamp(kind):
        array = array.cast(pa.int64())
    elif not (pa.types.is_integer(kind) or pa.types.is_decimal(kind) or pa.types.is_boolean(kind)):
        raise ValueError(f"columns of type {kind} have no order here")
    return [LOW if v is None else v for v in array.to_pylist()] if array.null_count else array.to_pylist()


def restored(values: tuple, kind: pa.DataType) -> pa.Array:
    """The column that `comparable` was made of."""
    if pa.types.is_floating(kind):
        return pa.array([(None, *v)[-1] if len(v) < 2 else float("nan") for v in values], kind)
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pa.array([v[1:] if v else None for v in values], kind)
    plain = pa.array([None if v == LOW else v for v in values] if LOW in values else values, pa.int64() if pa.types.is_timestamp(kind) else pa.int32() if pa.types.is_date(kind) else kind)
    return plain if plain.type == kind else plain.cast(kind)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = min(BLOCK_ROWS, max(1, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            rows = list(zip(*map(comparable, batch.slice(k, step).columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)], pa.binary())], ["n", "rows"])


def _blocks(ranked: Iterator[tuple[tuple, int]], schema: pa.Schema, size: int) -> Iterator[tuple[int, bytes]]:
    """Rank of the first row, and rows of one file as a record batch."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for _, own in itertools.groupby(ranked, key=lambda pair: pair[1] // size):
        while chunk := list(itertools.islice(own, BLOCK_ROWS)):
            columns = list(zip(*(row for row, _ in chunk), strict=True))[1:]
            batch = pa.RecordBatch.from_arrays([restored(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=options) as stream:
                stream.write_batch(batch)
            yield chunk[0][1], sink.getvalue().to_pybytes()


class _File:
    """One file that is written as a stream and then moved to its place, and what is said of it."""

    def __init__(self, folder: str, name: str, schema: pa.Schema, value: int | None):
        self.path, self.value = f"{folder}/{name}", value
        self.system, self.target = pyarrow.fs.FileSystem.from_uri(self.path)
        self.draft = f"{self.system.normalize_path(self.target.rpartition('/')[0])}.drafts/{name}-{uuid.uuid4().hex}"
        self.system.create_dir(self.draft.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.draft)
        self.writer = pq.ParquetWriter(self.out, schema, compression="zstd")
        self.rows = self.cents = 0
        self.ids = hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        self.writer.write_batch(batch)
        ids = ",".join("" if v is None else str(v) for v in batch.column(0).to_pylist())
        self.ids.update(f",{ids}".encode() if self.rows else ids.encode())
        self.rows += batch.num_rows
        if self.value is not None:
            values = pc.fill_null(batch.column(self.value).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            self.cents += int(np.floor(100 * np.where(np.isfinite(values), values, 0) + 0.5).astype(np.int64).sum())

    def close(self) -> None:
        """Puts the file into place, over what an earlier attempt has left; nothing is put there for a file without rows."""
        self.writer.close()
        self.out.close()
        if self.rows:
            self.system.create_dir(self.target.rpartition("/")[0], recursive=True)
            if self.system.get_file_info(self.target).type != pyarrow.fs.FileType.NotFound:
                self.system.delete_file(self.target)
            self.system.move(self.draft, self.target)
        else:
            self.system.delete_file(self.draft)

    def info(self, file_no: int, erased: int, rewritten: bool) -> tuple:
        return file_no, self.rows, erased, self.cents, rewritten, self.ids.hexdigest(), self.path


@dataclass
class Written:
    """A table as numbered files, and the links of its rows: (value of the linked column, file number, rows)."""

    name: str
    folder: str
    schema: pa.Schema
    size: int
    rows: int
    link: int
    value: int | None
    files: list[tuple]
    links: RDD

    @property
    def parts(self) -> int:
        """Partitions for exchanges of links."""
        return max(self.links.context.defaultParallelism, self.rows // LINK_ROWS)

    def writers(self, files: int) -> int:
        """Tasks that write files; each file number belongs to one of them, which writes its files one after another."""
        return min(files, max(self.links.context.defaultParallelism, self.rows // SORTED_ROWS))


def _saved(rdd: RDD, spark: SparkSession, parts: int) -> RDD:
    """What tasks that write files tell, in the shared folder, so that reading it doesn't write the files again."""
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path, 1000)
    atexit.register(remove, spark, path)
    return spark.sparkContext.pickleFile(path).coalesce(parts)


def _told(rdd: RDD, kind: int) -> RDD:
    return rdd.filter(lambda x: x[0] == kind).map(lambda x: x[1])


def write_ordered(rows: DataFrame, order: Column, name: str, folder: str, link: str, value: str | None = None) -> Written:
    """The table `name` in folder/name: rows by `order`, then by all columns from left to right, ascending, nulls first,
    as files of 1 + floor(n / FILES) rows, the last with the rest, numbered from 0.

    order is a column of whole numbers without nulls. Rows of which all columns are equal stand next to each other; NaN comes after all
    numbers. An empty table gives no file. Columns may have any names, and any type that has an order; arrays, maps and
    structs are refused. The order is a total one up to equal rows, so running again gives the same files.
    """
    return _write(rows.select(order.alias("order"), F.struct("*").alias("row")), name, folder, link, value)


def _write(rows: DataFrame, name: str, folder: str, link: str, value: str | None) -> Written:
    """write_ordered for rows as structs, with their order beside them."""
    spark = rows.sparkSession
    blank = rows.select("row.*").limit(0).toArrow().schema
    schema = pa.schema([pa.field(f.name, f.type) for f in blank])
    flat = rows.select(F.col("order").cast("long"), *(F.col("row")[c].alias(f"c{k}") for k, c in enumerate(schema.names)))
    packed = materialise(flat.mapInArrow(_tuples, "n long, rows binary"), f"rows-{name}", FILE_BLOCKS)
    n = packed.agg(F.sum("n")).first()[0] or 0
    size, files = 1 + n // FILES, -(-n // (1 + n // FILES))
    at = f"{folder}/{name}"
    place, summed = schema.get_field_index(link), None if value is None else schema.get_field_index(value)
    done = Written(name, at, schema, size, n, place, summed, [], spark.sparkContext.emptyRDD())
    if not n:
        return done
    parts = min(max(1, n // SORTED_ROWS), SORTED_PARTS)
    ordered = packed.select("rows").rdd.flatMap(lambda r: pickle.loads(r[0])).sortBy(lambda row: row, numPartitions=parts)
    ordered.persist(StorageLevel.DISK_ONLY)  # for the count that ranking needs; what is lost is sorted again
    blocks = ordered.zipWithIndex().mapPartitions(lambda own: _blocks(own, schema, size))
    writers = done.writers(files)
    dealt = blocks.repartitionAndSortWithinPartitions(writers, lambda rank: rank // size * writers // files)

    def write(own: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        for file_no, blocks in itertools.groupby(own, key=lambda block: block[0] // size):
            file = _File(at, f"file-{file_no:05d}.parquet", schema, summed)
            for _, block in blocks:
                batch = pa.ipc.open_stream(block).read_next_batch()
                file.add(batch)
                for count in pc.value_counts(batch.column(place).drop_null()).to_pylist():
                    yield 0, (count["values"], file_no, count["counts"])
            file.close()
            yield 1, file.info(file_no, 0, False)

    told = _saved(dealt.mapPartitions(write), spark, done.parts)
    ordered.unpersist()
    discard(packed)
    release(spark)
    done.files = sorted(_told(told, 1).collect())  # FILES at most
    done.links = _told(told, 0)
    return done


def folded(written: Written) -> RDD:
    """(value, {file number: rows}), combined before the exchange: FILES entries for each value at most."""

    def put(into: dict, link: tuple[int, int]) -> dict:
        into[link[0]] = into.get(link[0], 0) + link[1]
        return into

    def both(one: dict, other: dict) -> dict:
        for link in other.items():
            put(one, link)
        return one

    return written.links.map(lambda x: (x[0], (x[1], x[2]))).combineByKey(lambda link: put({}, link), put, both, written.parts)


def rewrite(written: Written, victims: RDD, key: str | None = None) -> tuple[list[tuple], RDD]:
    """Erases the rows whose linked column is one of the victims (values, repeats allowed; nulls link nothing). Returns what is said of all
    final files, and the distinct values of `key` of erased rows, nulls left out.

    Only files that hold a victim are read and written again; one without survivors has no successor. The first
    files stay until `settle`. A writer holds the victims' values of its own file only, and reads it as a stream.
    """
    spark = SparkSession.getActiveSession()
    if not written.files:
        return [], spark.sparkContext.emptyRDD()
    paths = {f[0]: f[-1] for f in written.files}
    at, schema, place, summed = written.folder, written.schema, written.link, written.value
    taken = None if key is None else schema.get_field_index(key)
    held = folded(written).cogroup(victims.map(lambda v: (v, None)).reduceByKey(lambda a, _: a, written.parts), written.parts)
    marked = held.flatMap(lambda x: [(f, x[0]) for links in x[1][0] for f in links] if x[1][1] else [])

    def again(own: Iterator[tuple[int, object]]) -> Iterator[tuple]:
        for file_no, pairs in itertools.groupby(own, key=lambda pair: pair[0]):
            wanted = pa.array([v for _, v in pairs], schema.field(place).type)
            system, path = pyarrow.fs.FileSystem.from_uri(paths[file_no])
            file, erased = _File(at, f"file-{file_no:05d}-rewritten.parquet", schema, summed), 0
            with system.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1 << 16):
                    gone = pc.fill_null(pc.is_in(batch.column(place), value_set=wanted), False)
                    file.add(batch.filter(pc.invert(gone)))
                    erased += pc.sum(gone).as_py()
                    if taken is not None:
                        for value in pc.unique(batch.column(taken).filter(gone).drop_null()).to_pylist():
                            yield 0, value
            file.close()
            yield 1, file.info(file_no, erased, True)

    files = len(paths)
    writers = written.writers(files)
    dealt = marked.repartitionAndSortWithinPartitions(writers, lambda file_no: file_no * writers // files)
    told = _saved(dealt.mapPartitions(again), spark, written.parts)
    fresh = {f[0]: f for f in _told(told, 1).collect()}  # FILES at most
    return [fresh.get(f[0], f) for f in written.files], _told(told, 0).map(lambda v: (v, None)).reduceByKey(lambda a, _: a, written.parts).keys()


def settle(written: Written, final: list[tuple]) -> list[tuple]:
    """Deletes the files that have been rewritten or emptied; returns what is said of those that stay. Doing so twice
    changes nothing."""
    spark = SparkSession.getActiveSession()
    for old, new in zip(written.files, final, strict=True):
        if new is not old:
            remove(spark, old[-1])
    remove(spark, f"{written.folder}.drafts")
    columns = ",".join(written.schema.names)
    return [(*f[:5], written.name, f[5], columns, f[6]) for f in final if f[1]]


def cascade(steps: list[tuple[Written, str | None, Callable[[dict[str, RDD]], RDD]]]) -> list[tuple]:
    """Erases from table to table: each step is a written table, the column that its erased rows hand on, and the victims
    as a function of what earlier tables have handed on, by their names. Nothing is deleted before the last table is rewritten."""
    handed: dict[str, RDD] = {}
    finals = []
    for written, key, victims in steps:
        final, handed[written.name] = rewrite(written, victims(handed), key)
        finals.append((written, final))
    return [info for written, final in finals for info in settle(written, final)]


def _crc(value: Column) -> Column:
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")))


def busiest_master(clients: DataFrame, clicks: DataFrame) -> DataFrame:
    """The master whose clients together have most clicks, as one row or none; the smallest on ties."""
    counts = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    masters = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    of = masters.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return of.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, clicks, sales, lines = (table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines"))
    folder = f"{shared_dir(spark)}/erased-{uuid.uuid4().hex}"
    by_client = _crc(F.col("client_id"))
    one = write_ordered(clients, by_client, "clients", folder, "master_id", "balance")
    two = write_ordered(clicks, by_client, "clicks", folder, "client_id", "value")
    three = write_ordered(sales, by_client, "sales", folder, "client_id", "total")
    owners = materialise(sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("_owner")).toDF("_sale", "_owner"), "owners")
    of = lines.select(F.struct("*").alias("row")).join(owners, F.col("row")["sale_id"] == F.col("_sale"), "left")
    four = _write(of.select(_crc(F.col("_owner")).alias("order"), "row"), "sale_lines", folder, "sale_id", "amount")
    discard(owners)
    masters = clients.where("master_id is not null").where(_crc(F.col("master_id")) % 200 == 0).select("master_id").union(busiest_master(clients, clicks))
    info = cascade([
        (one, "client_id", lambda _: masters.rdd.map(lambda r: r[0])),
        (two, None, lambda handed: handed["clients"]),
        (three, "sale_id", lambda handed: handed["clients"]),
        (four, None, lambda handed: handed["sales"]),
    ])
    return spark.createDataFrame(info, INFO)
