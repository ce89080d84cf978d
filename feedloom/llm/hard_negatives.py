"""Operator 13: hard negatives by Kronecker-packed products.

For an anchor, its positives are the best other rows of its label, and for
each positive the hard negatives are the best rows of other labels whose score
lies in a band below the positive's.  Scores are integer inner products.

Several candidates are scored by one product: the components of ``g``
candidates, made non-negative by a bias, lie in separated fields of one wide
integer, ``P_j = sum_s (c_sj + bias) << (F s)``.  ``sum_j a_j P_j`` then holds
the g scores in its fields, wide enough (F bits) that none runs into the next;
the known shift of each field is taken off again.  The wide integer is carried
by a float64 while all its sums stay below 2**53, where those are exact and
one matrix product does the work, and by Python integers of any width beyond.

1. Anchors are taken in blocks of at most ``block_rows``, which bounds what is
   broadcast and collected.  Candidates are streamed in their own partitions
   and never shuffled; a task returns the best few per anchor, which a window
   merges.
2. The positives of the block (at most ``positives`` per anchor) are broadcast;
   a second pass takes the best rows of other labels in each band.
   Each block's rows are written before the next one starts.

Numbers: a component x becomes floor(scale * x) computed in double; scores are
exact (one outside 64 bits is an error).

Defined cases: rows with a null id, label or vector, or a null or non-finite
component take no part; shorter vectors count as padded with zeros; a row with
the anchor's id is never its positive or negative; rows that repeat an id are
candidates each, and anchors that agree in id, label and vector are one; fewer
rows than asked for give fewer; ties go to the smaller id; a positive with a
negative score has an empty band; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stage
from feedloom.llm.topk import quantise
from feedloom.session import work_dir

BLOCK_ROWS = 8192
#: Candidates and anchors scored at once in a task.
TILE_ROWS, TILE_ANCHORS = 1024, 1024
#: Bits of integers that a float64 holds exactly; fields of a Python integer.
EXACT_BITS, WIDE_FIELDS = 53, 8


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products (rows of a x rows of c) of integers held in float64."""
    width, n = max(a.shape[1], c.shape[1]), len(c)
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    if not a.size or not c.size:
        return np.zeros((len(a), n))
    bias = int(-c.min()) if c.min() < 0 else 0
    top = max(1, int(np.abs(a).max()) * width * (int(c.max()) + bias))      # no field passes +- top
    bits = (2 * top).bit_length()
    fields = EXACT_BITS // bits
    if fields:
        shift, c = (lambda x, n: np.ldexp(x, n)), c + float(bias)
    else:
        as_int, fields = np.frompyfunc(int, 1, 1), WIDE_FIELDS
        shift, a, c = (lambda x, n: x * (1 << n)), as_int(a), as_int(c) + bias
    rows = -(-n // fields)
    c = np.concatenate([c, np.zeros((rows * fields - n, width), dtype=c.dtype)]).reshape(fields, rows, width)
    left = a @ sum(shift(c[s], bits * s) for s in range(fields)).T
    for s in range(fields):
        left = left + shift(np.array(top, dtype=a.dtype), bits * s)         # every field in 0 .. 2 top
    own, out = a.sum(axis=1)[:, None] * bias + top, []
    for _ in range(fields):
        rest = np.floor(np.ldexp(left, -bits)) if a.dtype != object else left >> bits
        out.append(left - shift(rest, bits) - own)
        left = rest
    return np.concatenate(out, axis=1)[:, :n]


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each group: score, then smaller id."""
    if not len(group):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(start, append=len(g)))
    return order[rank < k]


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and label is not null and v is not null").where(~odd)


def _matrix(col: pa.ListArray, scale: int) -> np.ndarray:
    return quantise(col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy()), scale)


def _best(shared, bands, k: int, scale: int):
    """Tasks of both passes: the k best candidates per slot.  Without bands a
    slot is an anchor, and candidates are other rows of its label.  With bands
    (slot -> anchor, lowest and highest score; slots in order of anchors) they
    are rows of other labels whose score lies in the band."""
    def run(batches):
        ids, labels, anchors = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]      # slot, score, id
        for b in batches:
            for at in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(at, TILE_ROWS)
                vid, lab = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = _matrix(part.column(2), scale)
                for lo in range(0, len(ids), TILE_ANCHORS):
                    cut = slice(lo, lo + TILE_ANCHORS)
                    scores = packed_products(anchors[cut], x)
                    own = labels[cut, None] == lab
                    use = (own if bands is None else ~own) & (ids[cut, None] != vid)
                    if bands is None:
                        r, c = _reach(scores, use, k)
                        found = [r + lo, scores[r, c], vid[c]]
                    else:
                        found = _in_bands(bands.value, lo, scores, use, vid)
                    held = [np.concatenate(z) for z in zip(held, found)]
                keep = first_of(*held, k)
                held = [z[keep] for z in held]
        slot, score, vid = held
        score = [int(s) for s in score] if score.dtype == object else score.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(vid), pa.array(score, pa.int64())],
                                         names=["slot", "vec_id", "score"])
    return run


def _reach(scores, use, k):
    """Entries that may be among the k best of their row: all that reach the
    k-th best score of the tile."""
    if scores.dtype == object or scores.shape[1] <= k:
        return np.nonzero(use)
    masked = np.where(use, scores, -np.inf)
    kth = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
    return np.nonzero(use & (masked >= kth[:, None]))


def _in_bands(bands, lo, scores, use, vid):
    """(slot, score, id) of the entries in the bands of the anchors at lo."""
    anchor, low, high = bands
    out = [[np.zeros(0, np.int64)], [np.zeros(0, scores.dtype)], [np.zeros(0, np.int64)]]
    first, last = np.searchsorted(anchor, (lo, lo + len(scores)))
    nth = np.arange(first, last) - np.searchsorted(anchor, anchor[first:last])      # of its anchor
    for j in range(int(nth.max()) + 1 if len(nth) else 0):
        slot = first + np.flatnonzero(nth == j)
        mine = scores[anchor[slot] - lo]
        hit = use[anchor[slot] - lo] & (mine <= high[slot, None]) & (mine >= low[slot, None])
        r, c = np.nonzero(hit)
        for z, new in zip(out, (slot[r], mine[r, c], vid[c])):
            z.append(new)
    return [np.concatenate(z) for z in out]


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100),
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every anchor (``is_anchor(id column)``) and each of its positives the
    best rows of other labels with band[0] * positive <= 100 * negative <=
    band[1] * positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    spark = rows.sparkSession
    rows = usable(rows, id_col, vec_col, label_col)
    key = F.md5(F.to_json("v"))
    anchors = rows.where(is_anchor(F.col("vec_id"))).withColumn("key", key).dropDuplicates(["vec_id", "label", "key"])
    anchors = stage(anchors, "anchors")
    place, schema = F.struct("vec_id", "label", "key"), "slot long, vec_id long, score long"
    best = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    root, paths, last = work_dir(spark, "llm-hard-negatives"), [], None
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    while True:
        after = anchors if last is None else anchors.where(
            place > F.struct(F.lit(last[0]).alias("vec_id"), F.lit(last[1]).alias("label"), F.lit(last[2]).alias("key")))
        block = after.orderBy("vec_id", "label", "key").limit(block_rows).toArrow()
        if not block.num_rows:
            break
        ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
        last = (int(ids[-1]), int(labels[-1]), block["key"][-1].as_py())
        shared = spark.sparkContext.broadcast((ids, labels, _matrix(block["v"].combine_chunks(), scale)))
        merged = lambda bands, k: (rows.mapInArrow(_best(shared, bands, k, scale), schema)
                                   .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        pos = merged(None, positives).orderBy("slot", "rank").toArrow()
        anchor, pid, score = (pos[c].to_numpy() for c in ("slot", "vec_id", "score"))
        exact = score if np.abs(score).max(initial=0) < 2 ** 53 else score.astype(object)
        bands = spark.sparkContext.broadcast((anchor, -(-band[0] * exact // 100), band[1] * exact // 100))
        named = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": pid,
                                                "positive_score": score}))
        # at most block_rows times positives names
        out = merged(bands, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        paths.append(f"{root}/block-{len(paths)}")
        out.join(F.broadcast(named), "slot").select(*(n.split()[0] for n in names.split(", "))).write.parquet(paths[-1])
        for b in (shared, bands):
            b.unpersist()
        if block.num_rows < block_rows:
            break
    return spark.read.schema(names).parquet(*paths) if paths else spark.createDataFrame([], names)
