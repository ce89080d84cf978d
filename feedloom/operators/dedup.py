"""Near-duplicate rejection at ingest (D1, D2) and the offline dedup job's
grouping and resolution (D3, D4, A8-A10, A14, M5).

* D2 first-wins ingest: in arrival order a row is rejected if a stored row
  or an earlier *accepted* row has similarity >= threshold; rejected rows
  suppress nobody; rows without a vector are accepted and suppress nobody.
  Decided in rounds over the first of each group of equal vectors: undecided
  rows stream past the tiles of undecided and newly accepted ones and bring
  back one row each, whether an accepted row is near and which undecided one
  is the earliest.  No list of similar pairs is made: a cluster of m near
  copies costs m rows a round and not m squared.
* D3 greedy groups: in id order, an article not yet processed with a
  vector takes its k=20 nearest (self included) at >= threshold; if any
  other remains, the smallest id of all is the keeper, the rest join the
  keeper's set, and all of them are marked processed.  Seeds are the
  first-in-order independent set of the directed kNN graph (edges from
  lower to higher id), then keeper = min, groups merged per keeper.
* D4 resolution: in group order (first seed), a group is applied iff its
  keeper was not removed by an earlier applied group.
"""

from __future__ import annotations

import functools
import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.fixpoint import first_in_order_independent
from feedloom.operators.similarity import (Layout, Side, cells_within, close_pairs, distance_limit, exact_pairs, knn_join, lay_out,
                                           is_filed, is_wide, nearest_match, stream_past, vector_rows)
from feedloom.session import ensure_checkpoint_dir, staged

log = logging.getLogger(__name__)

# The callers' similarity threshold and neighbour count.
DEFAULT_THRESHOLD = 0.70
DEDUP_K = 20


# ------------------------------------------------------------------ D2

def ingest_dedup(batch: DataFrame, store_vectors: DataFrame | None, threshold: float = DEFAULT_THRESHOLD,
                 id_col: str = "article_id", pos_col: str = "pos", vec: str = "embedding",
                 block_rows: int | None = None, hits: DataFrame | None = None) -> DataFrame:
    """D1 + D2: batch ``(id, pos, embedding)`` -> ``(id, pos, accepted,
    duplicate_id, similarity, reason)``.  A rejected row names the most
    similar row that was stored before it came: one of the store (``reason``
    'store') or an earlier accepted one of the batch ('batch'), ties to the
    smaller id.  ``hits`` (id, y, similarity) may give the matches in the store
    instead of its vectors."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    rows = batch.select(F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), F.col(vec).alias("embedding"))
    vecs = rows.where(F.col("embedding").isNotNull()).withColumn("key", _vector_key()("embedding"))
    vecs = staged(vecs, "dedup-vectors")

    if hits is None:
        hits = spark.createDataFrame([], "id long, y long, similarity double")
    else:
        hits = hits.select("id", "y", "similarity").checkpoint()
    if store_vectors is not None:
        store = store_vectors.select(F.col("article_id").alias("sid"), F.col("embedding"))
        hits = nearest_match(vecs, store, threshold, batch_id="id", store_id="sid", block_rows=block_rows).select(
            F.col("x").alias("id"), F.col("duplicate_id").alias("y"), "similarity").checkpoint()

    # equal vectors: only the first of each can be accepted
    first = vecs.groupBy("key").agg(F.min(F.struct("pos", "id")).alias("f")).select("f.id")
    free = first.join(hits.select("id"), "id", "left_anti")
    numbered = lambda df: vector_rows(df, "id", "embedding", F.col("pos"))
    every = numbered(vecs)
    # vectors in files are written once, for both sides
    at = lay_out(every if is_wide(every) else numbered(vecs.join(free, "id", "left_semi")), block_rows)
    accepted, in_batch = spark.createDataFrame([], "id long"), spark.createDataFrame([], "id long, y long, similarity double")
    if at is not None:
        if is_filed(at.rows):
            every = at.rows.drop("cell")
            at = at._replace(rows=at.rows.join(free, "id", "left_semi").checkpoint())
        sent = cells_within(every, at, distance_limit(threshold)).checkpoint()
        accepted = first_wins(sent, at, threshold)
        # what each row that is not accepted matched in the batch
        in_batch = (stream_past(sent.join(accepted, "id", "left_anti"), at, _nearest_before(threshold), "id long, y long, similarity double",
                                right=at.rows.join(accepted, "id", "left_semi")))
    best = (hits.withColumn("reason", F.lit("store"))
            .unionByName(in_batch.withColumn("reason", F.lit("batch")))
            .groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "y", "similarity", "reason")).alias("b")))
    out = rows.select("id", "pos").join(best, "id", "left").join(accepted.withColumn("in", F.lit(True)), "id", "left")
    rejected = F.col("in").isNull() & F.col("b").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("pos").alias(pos_col), (~rejected).alias("accepted"),
                      F.when(rejected, F.col("b.y")).alias("duplicate_id"),
                      F.when(rejected, F.col("b.similarity")).alias("similarity"),
                      F.when(rejected, F.col("b.reason")).alias("reason"))


@functools.lru_cache(maxsize=None)
def _vector_key():
    """MD5 of a vector's numbers: equal vectors have one key."""

    @F.arrow_udf(T.BinaryType())
    def vector_key(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        return pa.array([hashlib.md5(flat[lo:hi].tobytes(), usedforsecurity=False).digest() for lo, hi in zip(ends, ends[1:])], pa.binary())

    return vector_key


def _near_before(left: Side, tile: Side, threshold: float, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(left row, tile row, similarity) of the pairs at the threshold whose tile
    row arrived first (the tile is in that order): with ``nearest`` those that can be a row's most similar
    one, else all and no similarity."""
    limit = 2.0 * (1.0 - threshold) if threshold > 0 else np.inf
    r, c, d2, rounding = close_pairs(left, tile.first(int(np.searchsorted(tile.ord, left.ord.max()))), limit)
    before = tile.ord[c] < left.ord[r]
    r, c, d2 = r[before], c[before], None if d2 is None else d2[before]
    if d2 is not None and nearest and len(r) and threshold > 0:
        start = np.flatnonzero(np.diff(r, prepend=-1))
        held = np.diff(np.r_[start, len(r)])
        can = d2 <= np.repeat(np.minimum.reduceat(d2, start), held) + 2 * rounding
        r, c = r[can], c[can]
    # without similarities, only what the rounding leaves open is measured
    open_ = np.ones(len(r), bool) if nearest or d2 is None else d2 > limit - rounding
    sim = np.ones(len(r))
    d = np.sqrt(exact_pairs(left.vec, r[open_], tile.vec, c[open_]))
    sim[open_] = np.maximum(0.0, 1.0 - d * d / 2.0)
    keep = sim >= threshold
    return r[keep], c[keep], sim[keep] if nearest else None


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=-1))


def _blockers(threshold: float):
    """Per left row: whether an accepted tile row (mark 1) comes before it, and
    the earliest undecided one."""
    def fn(tile: Side, left: Side):
        r, c, _ = _near_before(left, tile, threshold, False)
        if not len(r):
            return None
        order = np.lexsort((tile.id[c], tile.ord[c], 1 - tile.mark[c], r))
        r, c = r[order], c[order]
        top = _first_of_runs(r)
        r, c = r[top], c[top]
        return {"id": left.id[r], "done": tile.mark[c].astype(np.int32), "ord": tile.ord[c], "y": tile.id[c]}
    return fn


def _nearest_before(threshold: float):
    """Per left row: the most similar tile row that came before it."""
    def fn(tile: Side, left: Side):
        r, c, sim = _near_before(left, tile, threshold, True)
        if not len(r):
            return None
        order = np.lexsort((tile.id[c], -sim, r))
        r, c, sim = r[order], c[order], sim[order]
        top = _first_of_runs(r)
        return {"id": left.id[r[top]], "y": tile.id[c[top]], "similarity": sim[top]}
    return fn


def first_wins(sent: DataFrame, at: Layout, threshold: float) -> DataFrame:
    """(id) of the accepted ones among the rows of the layout, in arrival order
    (``ord``).  ``sent``: those rows (and perhaps others) with their cells.

    A round accepts the undecided rows that no accepted or undecided row comes
    before at the threshold, and rejects those before which an accepted one
    does; a row whose earliest undecided predecessor is accepted goes at once.
    An accepted row is compared in the round after that and never again."""
    undecided, fresh, parts, rounds = at.rows.select("id").checkpoint(), None, [], 0
    remaining = undecided.count()
    while remaining:
        rounds += 1
        right = at.rows.join(undecided, "id", "left_semi").withColumn("mark", F.lit(0))
        if fresh is not None:
            right = right.unionByName(at.rows.join(fresh, "id", "left_semi").withColumn("mark", F.lit(1)))
        met = stream_past(sent.join(undecided, "id", "left_semi"), at, _blockers(threshold), "id long, done int, ord long, y long", right=right)
        blocked = met.groupBy("id").agg(F.max("done").alias("done"), F.min(F.when(F.col("done") == 0, F.struct("ord", "y"))).alias("first"))
        blocked = blocked.select("id", "done", "first.y").checkpoint()
        fresh = undecided.join(blocked.select("id"), "id", "left_anti").checkpoint()
        parts.append(fresh)
        waiting = blocked.where("done = 0").join(fresh.select(F.col("id").alias("y")), "y", "left_anti")
        undecided = waiting.select("id").checkpoint()
        remaining = undecided.count()
        log.info("first wins, round %d: %d undecided", rounds, remaining)
    out = parts[0] if parts else undecided
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.checkpoint() if len(parts) > 1 else out


# ------------------------------------------------------------------ D3

def neighbours(vectors: DataFrame, threshold: float = DEFAULT_THRESHOLD, k: int = DEDUP_K,
               block_rows: int | None = None) -> DataFrame:
    """N(x): the k nearest (self counted) at >= threshold, self removed."""
    nn = knn_join(vectors, vectors, k, threshold, block_rows=block_rows)
    return nn.where(F.col("x") != F.col("y")).select("x", "y", "similarity")


def duplicate_groups(vectors: DataFrame, article_ids: DataFrame | None = None,
                     threshold: float = DEFAULT_THRESHOLD, k: int = DEDUP_K,
                     block_rows: int | None = None) -> DataFrame:
    """D3 + A8 + A9: ``(keep_id, member_id, group_pos)``; ``group_pos`` is
    the first seed that named the keeper (the group's creation order)."""
    ensure_checkpoint_dir(vectors.sparkSession)
    v = vectors.where(F.col("embedding").isNotNull())
    if article_ids is not None:   # only ids present in the store take part (Q2)
        v = v.join(article_ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    # the vectors are read by both sides of the blocked product (and counted
    # to size the blocks): compute them once
    v = staged(v.select("article_id", "embedding"), "group-vectors")
    nb = neighbours(v, threshold, k, block_rows).checkpoint()
    cand = nb.select(F.col("x").alias("node")).distinct()
    edges = (nb.where(F.col("x") < F.col("y"))
             .select(F.col("x").alias("src"), F.col("y").alias("dst"))
             .join(cand.select(F.col("node").alias("dst")), "dst", "left_semi"))
    seeds = first_in_order_independent(cand, edges).where("chosen").select(F.col("node").alias("seed"))
    members = (nb.join(seeds, nb.x == seeds.seed).select("seed", F.col("y").alias("m"))
               .unionByName(seeds.select("seed", F.col("seed").alias("m"))))
    keeper = members.groupBy("seed").agg(F.min("m").alias("keep_id"))          # A8
    rows = members.join(keeper, "seed").where(F.col("m") != F.col("keep_id"))
    pos = keeper.groupBy("keep_id").agg(F.min("seed").alias("group_pos"))       # A9 order
    pairs = rows.select("keep_id", F.col("m").alias("member_id")).distinct()    # A9 union, U3
    return pairs.join(pos, "keep_id")


# ------------------------------------------------------------------ D4

def resolve_groups(groups: DataFrame) -> DataFrame:
    """D4 + J10: ``(keep_id, group_pos, applied)`` — a group is applied iff
    its keeper was not removed by an earlier applied group."""
    g = groups.select("keep_id", "group_pos").distinct()
    m = groups.select(F.col("keep_id").alias("src"), F.col("group_pos").alias("src_pos"), "member_id")
    later = g.select(F.col("keep_id").alias("dst"), F.col("group_pos").alias("dst_pos"))
    edges = (m.join(later, m.member_id == later.dst)
             .where(F.col("src_pos") < F.col("dst_pos")).select("src", "dst"))
    applied = first_in_order_independent(g.select(F.col("keep_id").alias("node")), edges)
    return g.join(applied.select(F.col("node").alias("keep_id"), F.col("chosen").alias("applied")), "keep_id")


def removed_ids(groups: DataFrame, resolution: DataFrame) -> DataFrame:
    """Members of applied groups: the articles really deleted (M5)."""
    applied = resolution.where("applied").select("keep_id")
    return groups.join(applied, "keep_id", "left_semi").select(F.col("member_id").alias("id")).distinct()


def dedup_summary(articles: DataFrame, vectors: DataFrame, groups: DataFrame,
                  resolution: DataFrame, removed: DataFrame) -> DataFrame:
    """A10 + A13 + A14 as ``(metric, value)`` rows: original articles, with
    embedding, claimed (sum of group sizes, Q5), groups, skipped groups,
    removed, final articles, embeddings kept."""
    def one(df: DataFrame, name: str, expr) -> DataFrame:
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    n = F.count(F.lit(1))
    kept_vec = (vectors.where(F.col("embedding").isNotNull())
                .join(removed.select(F.col("id").alias("article_id")), "article_id", "left_anti"))
    final = articles.select("id").join(removed, "id", "left_anti")
    parts = [one(articles, "original_articles", n),
             one(vectors, "with_embedding", F.count("embedding")),
             one(groups, "claimed_duplicates", n),
             one(resolution, "groups", n),
             one(resolution, "skipped_groups", F.count(F.when(~F.col("applied"), 1))),
             one(removed, "removed", n),
             one(final, "final_articles", n),
             one(kept_vec, "embeddings_stored", n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
