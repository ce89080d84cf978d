"""Write-path operators as set-based rewrites.

The reference mutates a SQLite file row by row.  Here every mutation is a
function from the current tables (and a batch) to the next version of the
tables; ``feedloom.sources.store`` writes versions.  Semantics kept:

* M1 INSERT OR REPLACE by link is delete + insert: a replaced article gets
  a *new* id and a new ``created_at``; ids come from an AUTOINCREMENT
  counter, one per inserted row in arrival order, never reused (Q1).
* M4 cascade: bridge rows of deleted/replaced articles go with them.
* M2 get-or-create tag: an existing name keeps its id, new names get ids in
  first-seen order.
* M3 the tag set of every inserted article is its cleaned tag list (F15),
  duplicates ignored.
* M8 an article without tags is still stored.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.feed import small
from feedloom.operators.tagging import clean_tag_names
from feedloom.session import ensure_checkpoint_dir

ARTICLE_FIELDS = ("title", "summary", "link", "published", "updated", "source", "og_image")
_ROW_BITS = 33   # monotonically_increasing_id = (partition << 33) + row in partition


def max_id(df: DataFrame, col: str = "id") -> int:
    """Current high-water mark of an id column (0 for an empty table)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def dense_ids(df: DataFrame, order_cols: Sequence[str], base: int, id_col: str = "id", unique: bool = False) -> DataFrame:
    """Exact ids ``base+1 .. base+n`` in ``order_cols`` order without a
    single-partition window over them: range-partition and sort, count rows
    per partition, sum up the counts (a window over one row per partition),
    add.  The sorted, numbered rows are checkpointed first so a recomputation
    after an executor loss cannot renumber them.  Where the order columns are
    ``unique``, they alone are sorted and numbered, and the rows (with their
    texts) meet their numbers in a join."""
    ensure_checkpoint_dir(df.sparkSession)
    if unique:
        return df.join(dense_ids(df.select(*order_cols), order_cols, base, id_col), list(order_cols))
    cols = [F.col(c) for c in order_cols]
    ranged = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
              .withColumn("_mono", F.monotonically_increasing_id())
              .checkpoint())
    # rows before each partition: one small row per partition, joined back
    part = F.shiftright("_mono", _ROW_BITS)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_mono").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(id_col, (F.lit(base) + F.col("_before") + local + 1).cast("long")).drop("_mono", "_p", "_before"))


# ------------------------------------------------------------------ M7

def quarantine_articles(batch: DataFrame, dim: int | None = None, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """M7: rows that break NOT NULL title / NOT NULL non-empty link are set
    aside with a reason; the rest go on.  With ``dim``, so are rows whose vector
    has another length or holds a null or non-finite number (a null vector is
    none: that row goes on)."""
    reason = (F.when(F.col("title").isNull(), F.lit("null title"))
              .when(F.col("link").isNull() | (F.col("link") == F.lit("")), F.lit("missing link")))
    if dim is not None:
        odd = F.exists(vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
        reason = (reason.when(F.col(vec).isNotNull() & (F.size(vec) != F.lit(dim)), F.lit("vector length"))
                  .when(F.col(vec).isNotNull() & odd, F.lit("vector not finite")))
    marked = batch.withColumn("_reason", reason)
    return (marked.where(F.col("_reason").isNull()).drop("_reason"),
            marked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason"))


# ------------------------------------------------------------------ M1

def upsert_articles_delta(articles: DataFrame, batch: DataFrame, batch_ts, id_base: int | None = None
                          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1 + F16 as a delta: ``(added, replaced_ids, inserted)``.

    Every batch row is an insert in ``pos`` order and takes the next id; a
    later row with the same link replaces the earlier one (last write wins).
    ``added`` are the surviving new rows, ``replaced_ids(id)`` the stored
    articles they replace (delete + insert: Q1), ``inserted`` every batch row
    with its id (for M2/M3/S5: a replaced row's tags and vector were written
    before it was replaced)."""
    base = max_id(articles) if id_base is None else id_base
    numbered = dense_ids(batch, ["pos"], base, unique=True)      # arrival numbers are unique
    ts = F.lit(batch_ts).cast("timestamp_ntz")
    # last write per link: partial max per link (a hot link is pre-aggregated),
    # then a semi join on (link, pos), a key with no hot value
    last = numbered.groupBy("link").agg(F.max("pos").alias("pos"))
    latest = numbered.join(last, ["link", "pos"], "left_semi").withColumn("created_at", ts)
    # the store is only scanned for the batch's links (the small side is
    # broadcast by the planner when its size allows), never rewritten
    replaced = articles.join(latest.select("link"), "link", "left_semi").select("id")
    return latest.select(*articles.columns), replaced, numbered.withColumn("created_at", ts)


def upsert_articles(articles: DataFrame, batch: DataFrame, batch_ts, id_base: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """M1 as the whole next table: ``(new_articles, inserted)``."""
    added, replaced, inserted = upsert_articles_delta(articles, batch, batch_ts, id_base)
    kept = articles.join(replaced, "id", "left_anti")
    return kept.select(*articles.columns).unionByName(added), inserted


# ------------------------------------------------------------------ M2

def get_or_create_tags_delta(tags: DataFrame, inserted: DataFrame, batch_ts,
                             id_base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M2 as a delta: ``(created, names)``; ``names(article_id, pos, tag_idx,
    name)`` are the cleaned tag names of the inserted articles, written once:
    the tags behind them cost a pass over the texts each time they are asked."""
    names = inserted.select(F.col("id").alias("article_id"), "pos",
                            F.posexplode(clean_tag_names(F.col("tags"))).alias("tag_idx", "name")).checkpoint()
    first_seen = names.groupBy("name").agg(F.min(F.struct("pos", "tag_idx")).alias("_first"))
    fresh = first_seen.join(tags.select("name"), "name", "left_anti") \
        .select("name", F.col("_first.pos").alias("_p"), F.col("_first.tag_idx").alias("_i"))
    created = dense_ids(fresh, ["_p", "_i"], max_id(tags) if id_base is None else id_base) \
        .select("id", "name", F.lit(batch_ts).cast("timestamp_ntz").alias("created_at"))
    return created, names


def get_or_create_tags(tags: DataFrame, inserted: DataFrame, batch_ts) -> tuple[DataFrame, DataFrame]:
    """M2: returns ``(new_tags, names)``."""
    created, names = get_or_create_tags_delta(tags, inserted, batch_ts)
    return tags.select("id", "name", "created_at").unionByName(created), names


# ------------------------------------------------------------------ M3 + M4

def replace_tag_sets_delta(article_tags: DataFrame, replaced_ids: DataFrame, surviving_ids: DataFrame,
                           names: DataFrame, tags: DataFrame, batch_ts,
                           id_base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M3 + M4 as a delta: ``(added, deleted)`` — the bridge rows of replaced
    articles (id, tag_id) go (cascade); every surviving inserted article gets one
    row per distinct tag."""
    deleted = article_tags.join(replaced_ids.select(F.col("id").alias("article_id")), "article_id",
                                "left_semi").select("id", "tag_id")
    live_names = names.join(surviving_ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    # with a vocabulary of a checked size a hot name never shuffles
    pairs = (live_names.join(small(tags.select(F.col("id").alias("tag_id"), "name")), "name")
             .groupBy("article_id", "tag_id").agg(F.min("tag_idx").alias("_i")))
    numbered = dense_ids(pairs, ["article_id", "_i"], max_id(article_tags) if id_base is None else id_base)
    added = numbered.select("id", "article_id", "tag_id", F.lit(batch_ts).cast("timestamp_ntz").alias("created_at"))
    return added, deleted


def replace_tag_sets(article_tags: DataFrame, new_articles: DataFrame, names: DataFrame,
                     tags: DataFrame, batch_ts) -> DataFrame:
    """M3 + M4 as the whole next bridge table: rows of articles that no
    longer exist go (cascade); every inserted article still present gets one
    row per distinct tag."""
    alive = article_tags.join(new_articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    gone = article_tags.select(F.col("article_id").alias("id")).join(
        new_articles.select("id"), "id", "left_anti")
    added, _ = replace_tag_sets_delta(article_tags, gone, new_articles.select("id"), names, tags, batch_ts)
    return alive.select("id", "article_id", "tag_id", "created_at").unionByName(added)


# ------------------------------------------------------------------ S5 / S7

def upsert_embeddings(embeddings: DataFrame, inserted: DataFrame, vec: str = "embedding") -> DataFrame:
    """Store the vector of every inserted article (upsert by article_id).
    Vectors of replaced ids stay (no FK on the vector table, Q2)."""
    new = inserted.where(F.col(vec).isNotNull()).select(F.col("id").alias("article_id"), F.col(vec).alias("embedding"))
    return embeddings.join(new.select("article_id"), "article_id", "left_anti").unionByName(new)


def delete_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the vectors of ``ids(id)``."""
    return embeddings.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def lookup_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """S6 (bulk): vectors of ``ids(id)``; a missing id has no row."""
    return embeddings.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")


# ------------------------------------------------------------------ M5 / M6 / J11 / J12

def delete_articles(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """M5: articles minus ``ids(id)``."""
    return articles.join(ids.select("id"), "id", "left_anti")


def orphan_bridge_rows(article_tags: DataFrame, articles: DataFrame) -> DataFrame:
    """Bridge rows whose article is gone (keys are NOT NULL, so NOT IN
    is a plain anti join)."""
    return article_tags.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def unused_tags(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """Tags no bridge row uses."""
    used = article_tags.select(F.col("tag_id").alias("id")).distinct()
    return tags.join(used, "id", "left_anti")


def clean_up(articles: DataFrame, tags: DataFrame, article_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: J11 then J12 — returns (article_tags, tags)."""
    bridge = article_tags.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    kept_tags = tags.join(bridge.select(F.col("tag_id").alias("id")).distinct(), "id", "left_semi")
    return bridge, kept_tags


# ------------------------------------------------------------------ S8

def constraint_violations(articles: DataFrame, tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """One row per violation ``(constraint_name, key)``; empty when clean.
    A null key violates NOT NULL alone, and an unknown tag id is one violation,
    however many rows use it."""
    # every table once: its rows say what they claim, and one pre-aggregated
    # grouping by claim and key finds the claims that fail
    def says(df: DataFrame, *claims: tuple[Column, str, Column, int]) -> DataFrame:
        each = F.array(*[F.when(when, F.struct(F.lit(name).alias("constraint_name"), key.cast("string").alias("key"), F.lit(has).alias("has")))
                         for when, name, key, has in claims])
        return df.select(F.explode(F.array_compact(each)).alias("c")).select("c.*")

    yes, article_key, tag_key = F.lit(True), "article_tags.article_id FOREIGN KEY", "article_tags.tag_id FOREIGN KEY"
    title, link = F.col("title"), F.col("link")
    claims = says(articles, (title.isNull(), "articles.title NOT NULL", F.col("id"), 0), (link.isNull(), "articles.link NOT NULL", F.col("id"), 0),
                  (link.isNotNull(), "articles.link UNIQUE", link, 0), (yes, "articles.id PRIMARY KEY", F.col("id"), 0),
                  (yes, article_key, F.col("id"), 1))
    claims = claims.unionByName(says(tags, (yes, "tags.name UNIQUE", F.col("name"), 0), (yes, tag_key, F.col("id"), 1)))
    pair = F.concat_ws(",", F.col("article_id").cast("string"), F.col("tag_id").cast("string"))
    claims = claims.unionByName(says(article_tags, (yes, "article_tags (article_id, tag_id) UNIQUE", pair, 0),
                                     (yes, article_key, F.col("article_id"), 0), (yes, tag_key, F.col("tag_id"), 0)))
    found = claims.groupBy("constraint_name", "key").agg(F.count(F.when(F.col("has") == 0, 1)).alias("n"), F.max("has").alias("has"))
    # rows of a null title or link, and orphans, are a violation each; a repeated key and an unknown tag are one
    name, n = F.col("constraint_name"), F.col("n")
    times = (F.when(name.endswith("NOT NULL"), n).when(name == article_key, F.when(F.col("has") == 0, n).otherwise(0))
             .when(name == tag_key, F.when(F.col("has") == 0, 1).otherwise(0)).otherwise(F.when(n > 1, 1).otherwise(0)))
    return found.select("constraint_name", "key", times.cast("int").alias("times")).where("times > 0").select(
        "constraint_name", F.explode(F.array_repeat("key", F.col("times"))).alias("key"))
