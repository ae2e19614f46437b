"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import column, materialise, table

#: Pivots are the distinct vectors among at most four times as many rows, taken by a hash of the id: half as many as the
#: square root of the rows, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
#: Queries that are solved together, and bytes of vectors that one task holds at once.
BUNDLE_QUERIES = 4096
BLOCK_BYTES = 64 << 20
#: Products and sums of integers below this are exact in float64.
EXACT = float(1 << 53)


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec: floor(256 * x) of each component as packed float64, which holds these integers exactly.

    A vector that is null, empty or has a null or non-finite component is left out, and so is a null id.
    """
    whole = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column(batch, "embedding")
            ends = rows.offsets.to_numpy()
            flat = np.floor(256.0 * rows.values.to_numpy(zero_copy_only=False).astype(np.float64))
            own = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(own, pa.binary())], ["vec_id", "vec"])

    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(whole & F.col("vec_id").isNotNull())
    return chosen.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(packed, "vec_id long, vec binary")


def _matrix(vecs: pa.Array | list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled up with zeros, which add nothing to an inner product."""
    own = [np.frombuffer(v if isinstance(v, bytes) else v.as_py(), np.float64) for v in vecs]
    if all(len(v) == width for v in own):
        return np.stack(own) if own else np.zeros((0, width))
    out = np.zeros((len(own), width))
    for i, v in enumerate(own):
        out[i, : len(v)] = v
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers: by float64 where that is exact, else by Python's integers within long's range."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all rows of data but its own.

    data and queries: vec_id and vec as quantise() makes them. Ties go to the smaller vec_id; a query with fewer
    than k other rows gets them all. Rows with the query's id are its own; of query rows with equal ids one
    counts, the smallest as packed bytes; repeated rows of data each take part. Empty input gives an empty result.
    Vectors of unequal length meet on the components that both have: what one lacks counts as zero. Scores beyond the
    range of long are cut to its ends, and then tie.

    1. Every row joins the cell of its nearest pivot. Cells have summaries: rows, radius, and the same for queries.
    2. With pivots p and radii r, the product of a query in cell i with a row in cell j is at least
       pi.pj - |pi| rj - ui |pj| - ui rj. The cells with the best such bounds that hold k rows besides the most that
       share one query's id give each query cell a floor for its k-th best score.
    3. A row x can matter to query cell i only if pi.x + ui |x| reaches that floor; it is sent to the bundles of
       query cells that need it, at most one copy for each bundle of 4,096 queries.
    4. Each bundle's rows are dealt by a hash of their id into blocks that are solved by matrix products; each block
       gives at most k rows for each query, and these are ranked. A vector that fills a third of all rows is spread
       over all blocks like any other.

    The driver holds pivots and summaries only: at most MOST_PIVOTS rows.
    """
    data = materialise(data, "knn-data")
    n, width = data.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
    width //= 8
    pivots = pivots or int(min(max(n**0.5 / 2, LEAST_PIVOTS), MOST_PIVOTS))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(4 * pivots).select("vec").collect()  # bounded
    heads = _matrix([bytes(v) for v in dict.fromkeys(bytes(r.vec) for r in sample)][:pivots], width)
    empty = data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not len(heads):
        return empty
    head_norms = np.linalg.norm(heads, axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(column(batch, "vec"), width)
            norms = (own**2).sum(1)
            apart = np.maximum(norms[:, None] - 2 * own @ heads.T + head_norms**2, 0)
            cell = apart.argmin(1)
            far = np.sqrt(((own - heads[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], [*batch.schema.names, "cell", "far"])

    form = "vec_id long, vec binary, cell int, far double"
    asked = queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInArrow(assign, form)
    placed = data.mapInArrow(assign, form)
    summary = lambda df: df.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect()  # noqa: E731  a row for each pivot
    rows, radius = np.zeros(len(heads)), np.zeros(len(heads))
    for r in summary(placed):
        rows[r.cell], radius[r.cell] = r.rows, r.far
    count, reach = np.zeros(len(heads)), np.zeros(len(heads))
    for r in summary(asked):
        count[r.cell], reach[r.cell] = r.rows, r.far
    if not count.any():
        return empty

    # rows that a query leaves out as its own: as many as the most frequent query id has
    own_rows = placed.groupBy("vec_id").count().join(asked.select("vec_id"), "vec_id", "left_semi").agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    least = heads @ heads.T - np.outer(head_norms, radius) - np.outer(reach, head_norms) - np.outer(reach, radius)
    floor = np.full(len(heads), -np.inf)
    for i in np.flatnonzero(count):
        best = np.argsort(-least[i])
        enough = np.searchsorted(np.cumsum(rows[best]), k + own_rows)
        if enough < len(best):
            floor[i] = least[i, best[enough]]
    # bundles of query cells, in the order of their numbers, so that the driver and tasks agree
    bundle = ((np.cumsum(count) - count) // BUNDLE_QUERIES).astype(np.int32)
    asking = np.flatnonzero(count)
    blocks = max(-(-n * max(width, 1) * 8 // BLOCK_BYTES), min(32, -(-n // 256)))

    def needed(own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each row may be among the best of each query cell; the margin is beyond all rounding."""
        norms = np.linalg.norm(own, axis=1)
        best = own @ heads[cells].T + np.outer(norms, reach[cells])
        margin = 1e-6 + 1e-9 * (np.outer(norms, head_norms[cells] + reach[cells]) + np.where(np.isfinite(floor[cells]), np.abs(floor[cells]), 0))
        return best + margin >= floor[cells]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = needed(_matrix(column(batch, "vec"), width), asking)
            for b in np.unique(bundle[asking]):
                picked = np.flatnonzero(wanted[:, bundle[asking] == b].any(1))
                part = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([column(part, "vec_id"), column(part, "vec"), pa.array(np.full(len(picked), b), pa.int32())], ["vec_id", "vec", "bundle"])

    def to_bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = column(batch, "cell").to_numpy()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "vec"), pa.array(cells, pa.int32()), pa.array(bundle[cells], pa.int32())], ["vec_id", "vec", "cell", "bundle"])

    def solve(own: pa.Table, asked: pa.Table) -> pa.Table:
        form = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        out = [[np.zeros(0, np.int64)] * 3]
        if own.num_rows and asked.num_rows:
            ids, vecs = own["vec_id"].to_numpy(), _matrix(own["vec"].combine_chunks(), width)
            order = np.argsort(ids, kind="stable")
            ids, vecs = ids[order], vecs[order]
            cells, names = asked["cell"].to_numpy(), asked["vec_id"].to_numpy()
            lines = _matrix(asked["vec"].combine_chunks(), width)
            for cell in np.unique(cells):
                near = np.flatnonzero(needed(vecs, np.array([cell]))[:, 0])
                mine = np.flatnonzero(cells == cell)
                for at in range(0, len(mine) if len(near) else 0, 64):
                    some = mine[at : at + 64]
                    scores = _scores(lines[some], vecs[near])
                    for q, line in zip(names[some], scores, strict=True):
                        other = np.flatnonzero(ids[near] != q)
                        if len(other) > k:  # all that reach the k-th score, then by id, which ascends here
                            bar = np.partition(line[other], -k)[-k]
                            other = other[line[other] >= bar]
                            other = other[np.argsort(-line[other], kind="stable")][:k]
                        out.append([np.full(len(other), q), ids[near][other], line[other]])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=form)

    salt = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = placed.mapInArrow(send, "vec_id long, vec binary, bundle int").withColumn("salt", salt)
    right = asked.mapInArrow(to_bundle, "vec_id long, vec binary, cell int, bundle int").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("bundle", "salt").cogroup(right.groupBy("bundle", "salt")).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(data, data.where("vec_id % 50 = 0"))


OP8_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score
  from (select * from vectors where vec_id % 50 = 0) q join vectors d on q.vec_id <> d.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
