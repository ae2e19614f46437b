"""A stored keyword index: postings by shards of chunks, replaced file by file, read as a snapshot.

Chunks are dealt into shards of SHARD places. A posting row holds one term of one shard (places, counts, positions), so
no row grows with the collection, and a term that stands everywhere is spread over all shards. The task that reads a shard's
chunks writes its rows, in the order of terms, so that nothing is exchanged or sorted as a whole. A search sends the postings of
the queried terms (positions only for phrases) and the chunks' names to a task for each shard, which intersects arrays, scores
and keeps its best; only these are ranked against each other.

Writes are copies: a replaced file's shards are written anew without it, and a manifest, written last, says which shards
of which batches are current. Readers of an older manifest are not disturbed.

The vocabulary is kept as runs of term counts. A write adds one run, with what it adds and, negative, what the shards that
it drops had; of four runs of like size one is made. So a write reads its own postings and those of the shards it drops, and what is
summed up when a term is asked for are a few runs for each size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heliograph.config import DEFAULTS, Settings
from heliograph.functions.text import token_line, tokens
from heliograph.sources.tables import written

SHARD = 8192  # at most 32,768, as places are kept in two bytes
#: Queries that one pass over the shards answers; more are answered in several.
BLOCK = 20_000
_FAR = 1 << 32
#: So many runs of term counts whose sizes are within that factor of each other are merged.
TIER = 4

POSTINGS = "shard long, term string, place array<short>, tf array<int>, pos array<int>, ids array<string>, docs array<long>, chunks long, words long"
HITS = "query_id long, chunk_id string, doc_id long, score double, places long"


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, kind))


def invert(shard: np.ndarray, place: np.ndarray, words: pa.ListArray, ids: pa.Array, docs: pa.Array) -> Iterator[pa.RecordBatch]:
    """Postings of some chunks: a row for each term of each shard, and one without a term for the shard's chunks, whose tf are
    the chunks' lengths. chunks and words tell how many chunks a row has, and how many words of these."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("place", pa.list_(pa.int16())), *((n, pa.list_(pa.int32())) for n in ("tf", "pos")), ("ids", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())), ("chunks", pa.int64()), ("words", pa.int64())])
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(by_name)).cast(pa.string())
    code = np.empty(len(names), np.int64)
    code[by_name] = np.arange(len(names))
    term = code[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    numbers, of = np.unique(shard, return_inverse=True)
    order = np.argsort(of[row] * (len(names) + 1) + term, kind="stable")  # chunks and positions ascend, as the sort is stable
    term, row, position = term[order], row[order], position[order]
    if len(row):
        new_list = np.r_[True, (term[1:] != term[:-1]) | (of[row][1:] != of[row][:-1])]
        new_row = new_list | np.r_[True, row[1:] != row[:-1]]
        at, lists = np.flatnonzero(new_row), np.flatnonzero(new_list)
        counts = np.diff(np.r_[at, len(row)])
        by_row = np.searchsorted(at, lists)
        none = pa.nulls(len(lists))
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[row[lists]]), names.take(pa.array(term[lists])), _lists(place[row[at]], by_row, pa.int16()), _lists(counts, by_row, pa.int32()), _lists(position, lists, pa.int32()), none.cast(schema.field("ids").type), none.cast(schema.field("docs").type), pa.array(np.diff(np.r_[by_row, len(at)])), pa.array(np.diff(np.r_[lists, len(row)]))],
            schema=schema,
        )
    if len(shard):
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        held = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), values.take(pa.array(order)).cast(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array([""] * len(starts)), _lists(place[order], starts, pa.int16()), _lists(lengths[order], starts, pa.int32()), pa.nulls(len(starts)).cast(schema.field("pos").type), held(ids, pa.string()), held(docs, pa.int64()), pa.array(np.diff(np.r_[starts, len(order)])), pa.array(np.add.reduceat(lengths[order], starts))],
            schema=schema,
        )


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks (shard, place, words, chunk_id, doc_id) in the order of shards: a shard's are made at once."""
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, place, words, ids, docs = (pa.concat_arrays(c.chunks) for c in rows.columns)
        yield from invert(shard.to_numpy(), place.to_numpy(), words, ids, docs)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        own = batch.column(0).to_numpy()
        other = np.flatnonzero(own != own[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # from there on it is the last shard, which may go on
        if last or held[0].column(0)[0].as_py() != own[-1]:
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            yield from made(whole)
            held = [batch.slice(last)]
    if held:
        yield from made(pa.Table.from_batches(held))


def words_of(lines: pa.StringArray) -> pa.ListArray:
    """The words of lines that have one space between words; none of an empty or null one."""
    lines = pc.fill_null(lines, "")
    split = pc.split_pattern(lines, " ")
    counts = np.where(pc.equal(lines, "").to_numpy(zero_copy_only=False), 0, np.diff(split.offsets.to_numpy()))
    words = split.flatten()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), words.filter(pc.not_equal(words, "")))


def _inverted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _inverted, of chunks whose words are one line (shard, place, line, chunk_id, doc_id)."""
    names = ["shard", "place", "words", "chunk_id", "doc_id"]
    yield from _inverted(pa.RecordBatch.from_arrays([*b.columns[:2], words_of(b.column(2)), *b.columns[3:]], names=names) for b in batches)


@dataclass
class Shard:
    """Postings of the queried terms in one shard, as arrays: places, counts, and places with positions. names and docs are
    those of the chunks at all places."""

    length: np.ndarray
    names: np.ndarray
    docs: np.ndarray
    terms: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    by_name: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.Table, scoped: bool) -> Shard:
        """rows: posting rows, those without a term for the chunks, and with a null term for the places in scope."""
        places = rows["place"].combine_chunks()
        size = 1 + (pc.max(places.flatten()).as_py() or 0)
        out, live = cls(np.zeros(size, np.int64), *(np.full(size, None, object) for _ in range(2))), np.full(size, not scoped)
        for term, place, tf, pos, ids, docs in zip(rows["term"].to_pylist(), places, *(rows[c] for c in ("tf", "pos", "ids", "docs")), strict=True):
            place = place.values.to_numpy().astype(np.int64)
            if term is None:  # only these chunks are in scope
                live[place] = True
                continue
            tf = tf.values.to_numpy().astype(np.int64)
            if term == "":
                out.length[place], out.names[place], out.docs[place] = tf, ids.as_py(), docs.as_py()
                continue
            key = np.repeat(place, tf) * _FAR + pos.values.to_numpy() if pos.is_valid else np.zeros(0, np.int64)
            if term in out.terms:  # a shard that several tasks have read
                a, b, c = out.terms[term]
                order = np.argsort(np.r_[a, place])
                place, tf, key = np.r_[a, place][order], np.r_[b, tf][order], np.sort(np.r_[c, key])
            out.terms[term] = place, tf, key
        for term, (place, tf, key) in out.terms.items() if scoped else ():
            keep = live[place]
            out.terms[term] = place[keep], tf[keep], key[live[key // _FAR]]
        return out

    def order(self) -> np.ndarray:
        """The rank of each place by its chunk's name."""
        if self.by_name is None:
            self.by_name = np.empty(len(self.names), np.int64)
            self.by_name[np.argsort(np.where(self.names == None, "", self.names), kind="stable")] = np.arange(len(self.names))  # noqa: E711
        return self.by_name

    def holding(self, terms: list[str], least: int) -> np.ndarray:
        """Places of chunks that hold at least so many of these different terms."""
        own = [self.terms[t][0] for t in terms if t in self.terms]
        if len(own) < least:
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.bincount(np.concatenate(own), minlength=len(self.length)) >= least)

    def phrase(self, line: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of chunks in which these words stand one after another, and how often: by the rarest word first."""
        if any(t not in self.terms for t in line):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, *rest = sorted(range(len(line)), key=lambda i: len(self.terms[line[i]][2]))
        begin = self.terms[line[first]][2] - first
        for i in rest:
            begin = begin[np.isin(begin + i, self.terms[line[i]][2], assume_unique=True)]
        return np.unique(begin // _FAR, return_counts=True)

    def weight(self, term: str, idf: float, mean: float, s: Settings) -> np.ndarray:
        """What a term adds to the scores of its chunks, for all queries alike."""
        if term not in self.weights:
            place, tf, _ = self.terms[term]
            norm = s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * self.length[place] / mean)
            self.weights[term] = idf * tf * (s.bm25_k1 + 1) / (tf + norm)
        return self.weights[term]

    def scores(self, places: np.ndarray, terms: list[str], idf: dict[str, float], mean: float, s: Settings) -> np.ndarray:
        out = np.zeros(len(self.length))
        for t in terms:
            if t in self.terms:
                out[self.terms[t][0]] += self.weight(t, idf[t], mean, s)
        return np.round(out[places], 6)


class KeywordIndex:
    """An index in a folder that all machines share. Each change gives a new version; older ones stay readable until
    clean() removes what no longer counts."""

    def __init__(self, spark: SparkSession, folder: str, version: int):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    @classmethod
    def create(cls, folder: str, chunks: DataFrame, model: str = "") -> KeywordIndex:
        """chunks: chunk_id, doc_id, content; further columns are kept with them."""
        own = cls(chunks.sparkSession, folder, 0)
        return own._commit(None, chunks, model, True)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, model: str | None = None) -> KeywordIndex:
        """The newest whole version. With a model that isn't the one it was made for it is reset: everything has to be
        indexed again, as vectors and chunks of different models don't mix."""
        fs, root = cls._fs(spark, folder)
        names = [p.getPath().getName() for p in fs.listStatus(root)]
        done = [n for n in names if n.startswith("manifest-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        own = cls(spark, folder, max(int(n.removeprefix("manifest-")) for n in done))
        return own.reset(model) if model is not None and own.model() != model else own

    @staticmethod
    def _fs(spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest-{self.version}")

    def model(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/model-{self.version}").first().model

    def _read(self, name: str, shards: DataFrame | None = None) -> DataFrame:
        """Rows of the current shards (or of some shards), with their batch."""
        live = self._manifest() if shards is None else shards
        batches = [r.batch for r in live.select("batch").distinct().collect()]  # a row for each write since the last clean()
        schema = self._schema(name).add("batch", "string")
        if not batches:
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.option("basePath", f"{self.folder}/{name}").schema(schema).parquet(*(f"{self.folder}/{name}/batch={b}" for b in batches))
        return every if self.version == 1 and shards is None else every.join(live, ["batch", "shard"], "left_semi")

    def _schema(self, name: str):
        if name == "postings":
            return StructType.fromDDL(POSTINGS)
        return self.spark.read.parquet(f"{self.folder}/schema").schema

    def chunks(self) -> DataFrame:
        """The chunks as they were given."""
        return self._read("chunks").drop("batch", "shard", "place")

    def postings(self) -> DataFrame:
        """Posting rows of the current shards; a shard's number counts within its batch."""
        return self._read("postings")

    def terms(self, wanted: DataFrame | None = None) -> DataFrame:
        """term, df (chunks) and occurrences of every term, or of the wanted ones (term)."""
        every = self._term_runs([r.run for r in self._runs()])
        every = every if wanted is None else every.join(F.broadcast(wanted), "term", "left_semi")  # words of a block of queries
        return _summed(every).where("df > 0")

    def _runs(self) -> list:
        """Names and sizes of the version's runs: a few for each size."""
        return self.spark.read.parquet(f"{self.folder}/runs-{self.version}").collect()

    def _term_runs(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("term string, df long, occurrences long").parquet(*(f"{self.folder}/terms/{n}" for n in names))

    def _write_run(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/terms/{name}")
        return name, self._term_runs([name]).count()

    def _merged(self, runs: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Runs of which fewer than TIER are of like size."""
        while True:
            tiers: dict[int, list[tuple[str, int]]] = {}
            for run in runs:
                tiers.setdefault((max(run[1], 1).bit_length() - 1) // (TIER.bit_length() - 1), []).append(run)
            full = next((own for own in tiers.values() if len(own) >= TIER), None)
            if full is None:
                return runs
            made = self._write_run(_summed(self._term_runs([n for n, _ in full])).where("df <> 0"))
            runs = [run for run in runs if run not in full] + [made]

    def vocabulary(self, least: int = 3) -> DataFrame:
        return self.terms().where(F.length("term") >= least).select("term", "occurrences")

    def _commit(self, dropped: DataFrame | None, added: DataFrame, model: str, whole: bool = False) -> KeywordIndex:
        """Writes added chunks as a batch, then the manifest without the dropped shards and with the new ones. whole: the
        batch is all that there is."""
        batch, version = uuid.uuid4().hex, self.version + 1
        fs, _ = self._fs(self.spark, self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if fs.exists(path(f"{self.folder}/manifest-{version}")):
            raise RuntimeError(f"version {version} has been written already: open the newest one and try again")
        target = lambda name: f"{self.folder}/{name}/batch={batch}"
        number = F.monotonically_increasing_id()
        if not self.version:
            self.spark.createDataFrame([], added.drop("shard", "place").withColumns({"shard": F.lit(0).cast("long"), "place": F.lit(0)}).schema).write.parquet(f"{self.folder}/schema")
        added.drop("shard", "place").withColumn("n", number).withColumns({"shard": F.floor(F.col("n") / SHARD), "place": (F.col("n") % SHARD).cast("int")}).drop("n").write.parquet(target("chunks"))
        stored = self.spark.read.schema(self._schema("chunks")).parquet(target("chunks"))

        own = stored.select("shard", "place", token_line("content").alias("line"), "chunk_id", F.col("doc_id").cast("long"))
        own.mapInArrow(_inverted_lines, POSTINGS).write.parquet(target("postings"))
        fresh = stored.select(F.lit(batch).alias("batch"), "shard").distinct()
        kept = None if whole else self._manifest() if dropped is None else self._manifest().join(dropped, ["batch", "shard"], "left_anti")
        live = fresh if kept is None else kept.unionByName(fresh)
        next_ = KeywordIndex(self.spark, self.folder, version)
        live.write.mode("overwrite").parquet(f"{self.folder}/next-{version}")
        # terms and totals belong to the version, so they are written before it counts
        more = self.spark.read.schema(self._schema("postings")).parquet(target("postings"))
        less = None if whole or dropped is None else self._read("postings", dropped)
        delta = _counted(more, 1) if less is None else _counted(more, 1).unionByName(_counted(less, -1))
        runs = [] if whole else [(r.run, r.n) for r in self._runs()]
        runs = self._merged([*runs, self._write_run(_summed(delta).where("df <> 0 or occurrences <> 0"))])
        self.spark.createDataFrame(runs, "run string, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs-{version}")
        n_chunks, n_words = (0, 0) if whole else self.spark.read.parquet(f"{self.folder}/model-{self.version}").select("n_chunks", "n_words").first()
        for rows, sign in ((more, 1), (less, -1)):
            if rows is not None:
                own = rows.where("term = ''").agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
                n_chunks, n_words = n_chunks + sign * own[0], n_words + sign * own[1]
        self.spark.createDataFrame([(n_chunks, n_words, model)], "n_chunks long, n_words long, model string").write.mode("overwrite").parquet(f"{self.folder}/model-{version}")
        fs.rename(path(f"{self.folder}/next-{version}"), path(f"{self.folder}/manifest-{version}"))
        return next_

    def append(self, chunks: DataFrame) -> KeywordIndex:
        """Adds chunks of new files."""
        return self._commit(None, chunks, self.model())

    def replace(self, files: DataFrame, chunks: DataFrame) -> KeywordIndex:
        """Files (doc_id) with their new chunks; a file without any is deleted. Only shards that hold one of the files
        are written again; until the new manifest stands readers see the old chunks."""
        held = self._read("chunks").join(files.select("doc_id").distinct(), "doc_id", "left_semi").select("batch", "shard").distinct()
        kept = self._read("chunks").join(held, ["batch", "shard"], "left_semi").join(files.select("doc_id").distinct(), "doc_id", "left_anti").drop("batch")
        return self._commit(written(held), kept.drop("shard", "place").unionByName(chunks), self.model())

    def delete(self, files: DataFrame) -> KeywordIndex:
        return self.replace(files, self.chunks().where("false"))

    def purge(self, records: DataFrame) -> KeywordIndex:
        """Without the chunks of tombstones (records with deleted), and compacted."""
        return self.delete(records.where("deleted").select("doc_id")).compact()

    def compact(self) -> KeywordIndex:
        """All current chunks in one batch of full shards."""
        return self._commit(None, self.chunks(), self.model(), True)

    def reset(self, model: str) -> KeywordIndex:
        """An empty version for another model."""
        return self._commit(None, self.chunks().where("false"), model, True)

    def clean(self) -> None:
        """Deletes batches and versions that the newest version doesn't use."""
        fs, root = self._fs(self.spark, self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        live = {r.batch for r in self._manifest().select("batch").distinct().collect()}
        for name in ("chunks", "postings"):
            for status in fs.listStatus(path(f"{self.folder}/{name}")):
                if status.getPath().getName().removeprefix("batch=") not in live:
                    fs.delete(status.getPath(), True)
        for status in fs.listStatus(root):
            kind, _, version = status.getPath().getName().partition("-")
            if kind in ("manifest", "runs", "model", "next") and version and int(version) < self.version:
                fs.delete(status.getPath(), True)
        current = {r.run for r in self._runs()}
        for status in fs.listStatus(path(f"{self.folder}/terms")):
            if status.getPath().getName() not in current:
                fs.delete(status.getPath(), True)

    # -- searching ---------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, mode: str = "all", k: int | None = DEFAULTS.hits, scope: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
        """query_id, chunk_id, doc_id, score, places of the k best chunks of each query (all without k), by BM25.

        mode: "all" words, "half" of them at least, or "phrase": the words one after another (places says how often).
        scope (doc_id) restricts the collection before anything is ranked. Ties are ordered by chunk_id; scores are
        rounded to six places. Queries without a word find nothing. Queries are taken in blocks, so any number will do.
        """
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), tokens("query").alias("line")).where(F.size("line") > 0)
        n = asked.count()
        blocks = max(1, -(-n // BLOCK))
        out = None
        for b in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            hits = self._search_block(own, mode, k, scope, s)
            out = hits if out is None else out.unionByName(hits)
        return out

    def _search_block(self, asked: DataFrame, mode: str, k: int | None, scope: DataFrame | None, s: Settings) -> DataFrame:
        lines = {r.query_id: r.line for r in asked.collect()}  # a block of the stated queries
        if not lines:
            return self.spark.createDataFrame([], HITS)
        wanted = self.spark.createDataFrame([(t,) for t in sorted({t for line in lines.values() for t in line})], "term string")
        known = {r.term: r.df for r in self.terms(wanted).select("term", "df").collect()}
        totals = self.spark.read.parquet(f"{self.folder}/model-{self.version}").first()
        mean = totals.n_words / totals.n_chunks if totals.n_chunks else 1.0
        idf = {t: float(np.log(1 + (totals.n_chunks - df + 0.5) / (df + 0.5))) for t, df in known.items()}
        # queries that can be answered at all, with their different terms
        plan = []
        for q, line in sorted(lines.items()):
            terms = list(dict.fromkeys(line))
            least = len(terms) if mode != "half" else max(1, -(-len(terms) // 2))
            if sum(t in known for t in terms) >= least:
                plan.append((q, line, terms, least))
        columns = ["batch", "shard", "term", "place", "tf", "pos" if mode == "phrase" else F.lit(None).cast("array<int>").alias("pos")]
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        first, last = min(known, default=""), max(known, default="")
        met = self.postings().where((F.col("term") >= first) & (F.col("term") <= last)).join(F.broadcast(wanted), "term")
        rows = met.select(*columns, none("ids", "array<string>"), none("docs", "array<long>"))
        every = self.postings().where("term = ''")
        rows = rows.unionByName(every.select("batch", "shard", "term", "place", "tf", none("pos", "array<int>"), "ids", "docs"))
        if scope is not None:
            line = every.select("batch", "shard", F.explode(F.arrays_zip("place", "docs")).alias("c")).join(scope.select(F.col("doc_id").alias("_doc")).distinct(), F.col("c.docs") == F.col("_doc"), "left_semi")
            live = line.groupBy("batch", "shard").agg(F.collect_list("c.place").alias("place"))  # a shard's places
            rows = rows.unionByName(live.select("batch", "shard", none("term", "string"), "place", none("tf", "array<int>"), none("pos", "array<int>"), none("ids", "array<string>"), none("docs", "array<long>")))
        found = rows.groupBy("batch", "shard").applyInArrow(_solver(plan, mode, k, idf, mean, s, scope is not None), HITS)
        return found if k is None else written(ranked(found, k).drop("rank"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _solver(plan: list, mode: str, k: int | None, idf: dict[str, float], mean: float, s: Settings, scoped: bool) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.float64()), ("places", pa.int64())])

    def solve(rows: pa.Table) -> pa.Table:
        shard = Shard.of(rows, scoped)
        out = []
        for q, line, terms, least in plan:
            if mode == "phrase":
                places, counts = shard.phrase(line)
            else:
                places = shard.holding(terms, least)
                counts = np.ones(len(places), np.int64)
            if not len(places):
                continue
            score = shard.scores(places, terms, idf, mean, s)
            if k is not None and len(places) > k:  # all above the k-th score, and of those with it the first by name
                bar = np.partition(score, -k)[-k]
                above, equal = np.flatnonzero(score > bar), np.flatnonzero(score == bar)
                if len(equal) > k - len(above):
                    equal = equal[np.argsort(shard.order()[places[equal]])[: k - len(above)]]
                keep = np.r_[above, equal]
                places, counts, score = places[keep], counts[keep], score[keep]
            out.append((np.full(len(places), q), places, score, counts))
        if not out:
            return schema.empty_table()
        query, place, score, counts = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(query), pa.array(shard.names[place], pa.string()), pa.array(shard.docs[place], pa.int64()), pa.array(score), pa.array(counts)], schema=schema)

    return solve


def _counted(postings: DataFrame, sign: int) -> DataFrame:
    """term, df and occurrences of some shards' postings, negative for those that go."""
    by = postings.where("term <> ''").groupBy("term").agg(F.sum("chunks").alias("df"), F.sum("words").alias("occurrences"))
    return by.select("term", *((F.col(c) * sign).cast("long").alias(c) for c in ("df", "occurrences")))


def _summed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
