"""Operator 5: exact top-k search by a three-phase uniform threshold.

The score of a vector for a query is an integer inner product, the sum of m
partial scores over m groups of dimensions ("lists").

1. Gather: every task takes, per query and list, its local top k partial
   scores, and resolves the full scores of those vectors.  The k-th best full
   score found anywhere is a lower bound T of the true k-th score.
2. Broadcast the safe cutoff: a vector whose score reaches T has at least one
   partial score of T / m or more (else the sum would be below T).  Every task
   collects the entries that reach the cutoff in some list.
3. Resolve: the remaining partial scores of those entries are added exactly,
   entries below T fall away, and the k best per query stay.

Queries are a stated set; they are taken in blocks of at most ``block_rows``
vectors, which bounds what is collected and broadcast at once.  Candidates are
streamed in their own partitions and never shuffled.

Numbers: a component x becomes floor(scale * x) computed in double.  Scores
are exact: float64 products while every sum stays below 2**53 in magnitude,
Python integers beyond (a score outside 64 bits is an error).

Defined cases: vectors that are null, or hold a null or non-finite component
take no part, as queries or as candidates; a null id takes no part; shorter
vectors count as padded with zeros; rows that repeat an id and vector count
once; a query's own id is never among its results; fewer than k candidates
give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
#: Candidates scored at once in a task.
TILE_ROWS = 1024
#: Below this bound all float64 sums of integers are exact.
EXACT = float(2 ** 53)

ENTRY = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): id and vector, as doubles, of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd)


def quantise(flat: np.ndarray, lengths: np.ndarray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), zero-padded to the longest."""
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = np.floor(scale * flat)
    return out


def _matrix(col: pa.ListArray, scale: int) -> np.ndarray:
    return quantise(col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy()), scale)


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def partials(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores (queries x candidates) over each group of dimensions."""
    width = max(q.shape[1], x.shape[1])
    q, x = _pad(q, width), _pad(x, width)
    top = (np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0))
    if top[0] * top[1] * max(width, 1) * lists >= EXACT:
        as_int = np.frompyfunc(int, 1, 1)
        q, x = as_int(q), as_int(x)
    cuts = [width * g // lists for g in range(lists + 1)]
    return [q[:, a:b] @ x[:, a:b].T if b > a else np.zeros((len(q), len(x)), dtype=q.dtype) for a, b in zip(cuts, cuts[1:])]


def _entries(qids, vids, rows, cols, scores) -> pa.RecordBatch:
    scores = [int(s) for s in scores] if scores.dtype == object else scores.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[rows]), pa.array(vids[cols]), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def _tiles(batches, scale):
    for b in batches:
        for at in range(0, b.num_rows, TILE_ROWS):
            part = b.slice(at, TILE_ROWS)
            yield part.column(0).to_numpy(), _matrix(part.column(1), scale)


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 1024, lists: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best candidates of every query (``is_query(id column)``):
    query_id, rank from 1, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, last = spark.createDataFrame([], ENTRY), None
    while True:
        after = queries if last is None else queries.where(F.col("vec_id") > last)
        block = after.orderBy("vec_id").limit(block_rows).toArrow()
        if block.num_rows == 0:
            break
        qids, q = block["vec_id"].to_numpy(), _matrix(block["v"].combine_chunks(), scale)
        last = int(qids[-1])
        shared = spark.sparkContext.broadcast((qids, q))
        first = rows.mapInArrow(_gather(shared, k, lists, scale), ENTRY).distinct()
        bound = (first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
                 .select("query_id", "score").toArrow())
        cutoff = np.full(len(qids), np.iinfo(np.int64).min, dtype=np.int64)
        cutoff[np.searchsorted(qids, bound["query_id"].to_numpy())] = bound["score"].to_numpy()
        limit = spark.sparkContext.broadcast(cutoff)
        found = found.unionByName(rows.mapInArrow(_collect(shared, limit, lists, scale), ENTRY))
        if len(qids) < block_rows:
            break
    return (found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _gather(shared, k, lists, scale):
    """Phase 1, per task: the local top k of every list, fully resolved."""
    def run(batches):
        qids, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        for vids, x in _tiles(batches, scale):
            parts = partials(q, x, lists)
            total = sum(parts)
            own = qids[:, None] == vids[None, :]
            merged = []
            for g, p in enumerate(parts):
                p = np.where(own, -np.inf if p.dtype != object else -(1 << 200), p)
                ids, full = np.broadcast_to(vids, p.shape), total
                if best is not None:
                    p, ids, full = (np.concatenate(z, axis=1) for z in zip(best[g], (p, ids, full)))
                n = min(k, p.shape[1])
                keep = np.argsort(-p, axis=1, kind="stable")[:, :n] if p.dtype == object else np.argpartition(-p, n - 1, axis=1)[:, :n]
                merged.append(tuple(np.take_along_axis(z, keep, axis=1) for z in (p, ids, full)))
            best = merged
        for p, ids, full in best or []:
            r, c = np.nonzero(ids != qids[:, None])
            yield _entries(qids, ids[r, c], r, slice(None), full[r, c])
    return run


def _collect(shared, limit, lists, scale):
    """Phases 2 and 3, per task: entries that reach the cutoff in some list,
    their scores completed, those below the bound dropped."""
    def run(batches):
        qids, q = shared.value
        bound = limit.value
        for vids, x in _tiles(batches, scale):
            parts = partials(q, x, lists)
            if parts[0].dtype == object:
                low = bound.astype(object)[:, None]
                hit = np.logical_or.reduce([(p * lists >= low).astype(bool) for p in parts])
            else:
                hit = np.logical_or.reduce([p * float(lists) >= bound[:, None] for p in parts])
            hit &= qids[:, None] != vids[None, :]
            r, c = np.nonzero(hit)
            score = sum(p[r, c] for p in parts)
            stay = (score >= bound[r]).astype(bool)
            yield _entries(qids, vids, r[stay], c[stay], score[stay])
    return run
