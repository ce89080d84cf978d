"""The offline dedup job over a whole store.

    S9 snapshot -> S3 scan -> F1 text -> X3 embed -> S5 store vectors
      -> D3 groups -> D4 resolution -> M5 delete -> M6 clean-up -> A14 summary

An empty store ends early.  Groups and resolution are checkpointed into the
shared checkpoint folder (each is read several times, and each is the
result of an iterative fixpoint).  The job writes one batch: the vectors that
were missing, and the keys that go.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import embed_text
from feedloom.operators import mutate as M
from feedloom.operators.dedup import (DEDUP_K, DEFAULT_THRESHOLD, dedup_summary, duplicate_groups,
                                      removed_ids, resolve_groups)
from feedloom.operators.embed import EMBEDDING_DIM, embed
from feedloom.session import ensure_checkpoint_dir, staged
from feedloom.sources import store as ST


class DedupResult(NamedTuple):
    summary: DataFrame          # A14 as (metric, value)
    groups: DataFrame           # D3 (keep_id, member_id, group_pos)
    resolution: DataFrame       # D4 (keep_id, group_pos, applied)
    removed: DataFrame          # M5 (id)
    snapshot_path: str | None


def dedup_store(spark: SparkSession, root: str, at: dt.datetime, threshold: float = DEFAULT_THRESHOLD,
                k: int = DEDUP_K, dim: int = EMBEDDING_DIM, take_snapshot: bool = True) -> DedupResult:
    ensure_checkpoint_dir(spark)
    own = ST.Batch("dedup", int(at.strftime("%Y%m%d%H%M%S")))
    store = ST.open_store(spark, root, own)
    articles = store.articles
    if articles.limit(1).count() == 0:       # empty store: nothing to do
        empty = spark.createDataFrame([], "metric string, value long")
        none = spark.createDataFrame([], "keep_id long, member_id long, group_pos long")
        return DedupResult(empty, none, spark.createDataFrame([], "keep_id long, group_pos long, applied boolean"),
                           spark.createDataFrame([], "id long"), None)
    snap = ST.snapshot(spark, root, at) if take_snapshot else None               # S9
    text = articles.select("id", embed_text(F.col("title"), F.col("summary")).alias("_text"))  # S3, F1
    vectors = staged(embed(text, "id", "_text", dim)                             # X3
                     .select(F.col("id").alias("article_id"), "embedding"), "text-vectors")
    missing = staged(M.delete_embeddings(vectors.where("embedding is not null"),  # S5: a stored vector stays
                                         store.article_embeddings.select(F.col("article_id").alias("id"))), "missing-vectors")
    # the vectors are those of the articles, so no id needs to be looked up there
    groups = duplicate_groups(vectors.where("article_id is not null"), None, threshold, k).checkpoint()   # D3
    resolution = resolve_groups(groups).checkpoint()                             # D4
    removed = removed_ids(groups, resolution).checkpoint()
    summary = dedup_summary(articles, vectors, groups, resolution, removed)      # A14
    kept_articles = M.delete_articles(articles.select("id"), removed)            # M5
    kept_bridge, kept_tags = M.clean_up(kept_articles, store.tags, store.article_tags)  # M6: J11, J12
    gone = {"articles": removed.select("id"),
            "tags": store.tags.select("id").join(kept_tags.select("id"), "id", "left_anti").checkpoint(),
            "article_tags": store.article_tags.select("id", "tag_id").join(kept_bridge.select("id"), "id", "left_anti").checkpoint(),
            "article_embeddings": removed.select(F.col("id").alias("article_id"))}
    if removed.isEmpty():         # as the reference: without duplicates nothing is cleaned up
        gone = {}
    ST.write_batch(spark, root, own, {"article_embeddings": missing}, gone)
    return DedupResult(summary, groups, resolution, removed, snap)
