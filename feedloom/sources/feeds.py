"""Feed scans, and the entry clean-up P1-P4 + F4.

Feeds are landed as files first (fetching is not Spark's part); one
multi-path XML read covers the whole feed list (U1: union all, repeats
kept).  RSS ``<item>`` and Atom ``<entry>`` are both read with explicit
schemas; malformed records are kept in ``_corrupt_record`` and routed to
quarantine (M7) instead of failing the read.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schemas as S
from feedloom.functions.dates import feed_date_iso
from feedloom.functions.urls import source_name
from feedloom.operators.mutate import dense_ids


def feed_folder(landing: str, feed_url: str) -> str:
    """Where the files of a feed land: ``<landing>/feed=<URL, percent-encoded>``."""
    return f"{landing.rstrip('/')}/feed={quote(feed_url, safe='')}"


def feed_of_path(path: Column) -> Column:
    """The feed URL that a landed file's folder names, or the file's path.
    (The path column is itself percent-encoded, hence decoded twice.)"""
    folder = F.regexp_extract(path, r"/feed=([^/]+)/[^/]+$", 1)
    return F.when(folder != F.lit(""), F.url_decode(F.url_decode(folder))).otherwise(path)


def _read_feeds(spark: SparkSession, feeds, row_tag: str, schema) -> DataFrame:
    """Rows of the feeds' files with ``feed_url`` and ``pos``, the dense
    arrival number by (order of the feed list, place in the file).

    ``feeds`` is a path, a list of paths, or a list of (feed URL, path)."""
    feeds = [feeds] if isinstance(feeds, str) else list(feeds)
    listed = [(i, None, f) if isinstance(f, str) else (i, f[0], f[1]) for i, f in enumerate(feeds)]
    raw = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load([p for _, _, p in listed]))
    raw = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    # the list is the caller's; a listed folder or pattern stands for its files
    files = [(i, url, f) for i, url, p in listed for f in _files_of(spark, p)]
    order = F.broadcast(spark.createDataFrame(files, "_feed int, _url string, _key string").dropDuplicates(["_key"]))
    named = (raw.withColumn("_mono", F.monotonically_increasing_id())
             .withColumn("_key", F.regexp_replace(F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B"))), r"^file:/+", "/"))
             .join(order, "_key", "left")
             .withColumn("feed_url", F.coalesce("_url", feed_of_path(F.col("_path")))))
    return dense_ids(named, ["_feed", "_path", "_block", "_mono"], 0, "pos")


def _files_of(spark: SparkSession, path: str) -> list[str]:
    """Files that a listed path, folder or pattern stands for."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(p) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [re.sub(r"^file:/+", "/", s.getPath().toString()) for s in inside]
    return out


def read_rss(spark: SparkSession, feeds) -> DataFrame:
    """S1 + S2 + U1 (RSS 2.0): one row per ``<item>`` of every listed feed, in
    ENTRIES shape plus ``_corrupt_record``; repeats are kept."""
    return rss_columns(_read_feeds(spark, feeds, "item", S.RSS_ITEM))


def rss_columns(raw: DataFrame) -> DataFrame:
    """RSS_ITEM columns (plus ``feed_url``, ``pos``) to the ENTRIES shape."""
    return raw.select(
        "feed_url", "pos", "title", "link",
        F.col("description").alias("summary"),
        F.col("`content:encoded`").alias("content"),
        F.col("pubDate").alias("published_raw"),
        F.col("updated").alias("updated_raw"),
        "_corrupt_record")


def read_atom(spark: SparkSession, feeds) -> DataFrame:
    """S1 (Atom): link is the ``href`` of the first alternate (or only) link."""
    return atom_columns(_read_feeds(spark, feeds, "entry", S.ATOM_ENTRY))


def atom_columns(raw: DataFrame) -> DataFrame:
    """ATOM_ENTRY columns (plus ``feed_url``, ``pos``) to the ENTRIES shape."""
    alt = F.filter("link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == F.lit("alternate"))
    return raw.select(
        "feed_url", "pos",
        F.col("title._VALUE").alias("title"),
        F.try_element_at(alt, F.lit(1))["_href"].alias("link"),
        F.col("summary._VALUE").alias("summary"),
        F.col("content._VALUE").alias("content"),
        F.col("published").alias("published_raw"),
        F.col("updated").alias("updated_raw"),
        "_corrupt_record")


def parse_items(items: DataFrame, xml_col: str = "xml") -> DataFrame:
    """S1 over XML text already in a column (one ``<item>`` per row)."""
    parsed = items.withColumn("_item", F.from_xml(F.col(xml_col), S.RSS_ITEM,
                                                  {"mode": "PERMISSIVE"}))
    keep = [c for c in items.columns if c != xml_col]
    return parsed.select(*keep,
                         F.col("_item.title").alias("title"), F.col("_item.link").alias("link"),
                         F.col("_item.description").alias("summary"),
                         F.col("_item.`content:encoded`").alias("content"),
                         F.col("_item.pubDate").alias("published_raw"),
                         F.col("_item.updated").alias("updated_raw"))


def quarantine(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: split into (good, bad); a bad row never stops the good ones."""
    bad_cond = F.col("_corrupt_record").isNotNull()
    # A file scan that needs only the corrupt-record column is refused by
    # Spark; a (never false) test on a data column keeps one in every plan.
    with_data = F.length(F.coalesce(F.col("link"), F.lit(""))) >= F.lit(0)
    return (entries.where(~bad_cond & with_data).drop("_corrupt_record"),
            entries.where(bad_cond & with_data))


# ------------------------------------------------------------------ clean-up

def default_fields(entries: DataFrame) -> DataFrame:
    """Missing title -> 'Untitled', missing link/summary -> '' (an empty
    title stays empty)."""
    return (entries.withColumn("title", F.coalesce("title", F.lit("Untitled")))
                   .withColumn("link", F.coalesce("link", F.lit("")))
                   .withColumn("summary", F.coalesce("summary", F.lit(""))))


def with_link(entries: DataFrame) -> DataFrame:
    """Entries without a link are skipped."""
    return entries.where(F.col("link") != F.lit(""))


def summary_fallback(entries: DataFrame) -> DataFrame:
    """An empty summary takes the content's value when there is one."""
    return entries.withColumn(
        "summary", F.when(F.col("summary") == F.lit(""), F.coalesce("content", F.lit("")))
                    .otherwise(F.col("summary")))


def stored_among(store_links: DataFrame, entries: DataFrame) -> DataFrame:
    """The stored links that this batch mentions, distinct.

    The store's link column is the big side: an anti join against it would
    shuffle all of it every poll.  The batch's distinct links are the right
    side of a semi join, which the planner may broadcast by its own statistics;
    what comes back is no larger than the batch."""
    batch_links = entries.select("link").where(F.col("link").isNotNull() & (F.col("link") != F.lit(""))).distinct()
    return store_links.select("link").join(batch_links, "link", "left_semi").distinct()


def new_links_only(entries: DataFrame, store_links: DataFrame) -> DataFrame:
    """Keep entries whose link is not stored yet (set-based anti join;
    the store is checked, not the current batch — repeats pass, Q3)."""
    return entries.join(stored_among(store_links, entries), "link", "left_anti")


def clean_entries(entries: DataFrame, store_links: DataFrame | None = None) -> DataFrame:
    """P1 -> P2 -> J4 -> P3 -> F4 -> P4: raw entries to article rows."""
    e = with_link(default_fields(entries))
    if store_links is not None:
        e = new_links_only(e, store_links)
    e = summary_fallback(e)
    return e.select(
        "feed_url", "pos", "title", "summary", "link",
        feed_date_iso(F.col("published_raw")).alias("published"),
        feed_date_iso(F.col("updated_raw")).alias("updated"),
        source_name(F.col("feed_url")).alias("source"), "published_raw", "updated_raw")


def ingest_stats(entries: DataFrame, store_links: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per feed — entries, without link, already stored, new, and new
    ones with a preview image (``images``: url, og_image).

    Entries without a link never meet a join: as the one key ``''`` they would
    all land in one task."""
    e = default_fields(entries).select("feed_url", "link")
    linked = e.where(F.col("link") != F.lit(""))
    stored = stored_among(store_links, e).withColumn("_stored", F.lit(True))
    j = linked.join(stored, "link", "left")
    has_image = F.lit(False)
    if images is not None:
        j = j.join(images.where(F.col("og_image").isNotNull()).select(F.col("url").alias("link"), F.lit(True).alias("_img")),
                   "link", "left")
        has_image = F.col("_img").isNotNull()
    is_new = F.col("_stored").isNull()
    one = lambda c: F.count(F.when(c, 1))
    parts = (j.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entries"), F.lit(0).cast("long").alias("skipped_no_link"),
                                       one(~is_new).alias("skipped_stored"), one(is_new).alias("new_entries"),
                                       one(is_new & has_image).alias("images_found"))
             .unionByName(e.where(F.col("link") == F.lit("")).groupBy("feed_url").agg(
                 F.count(F.lit(1)).alias("entries"), F.count(F.lit(1)).alias("skipped_no_link"),
                 *(F.lit(0).cast("long").alias(c) for c in ("skipped_stored", "new_entries", "images_found")))))
    return parts.groupBy("feed_url").agg(*(F.sum(c).alias(c) for c in parts.columns[1:]))
