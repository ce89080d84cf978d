"""Feed reads over the store: tag counts, articles by tag, feed pages.

Store tables: ``articles(id, title, summary, link, published, updated,
source, og_image, created_at)``, ``tags(id, name, created_at)``,
``article_tags(id, article_id, tag_id, created_at)``.

Scale notes.  A closed vocabulary means a few tags each own a large share
of ``article_tags``: ``tag_id`` is a hot key.  So bridge rows are always
pre-aggregated by ``tag_id`` before they meet ``tags`` (A1, A2), and a
tag filter reaches the bridge as a broadcast of at most ``len(names)``
rows (names are UNIQUE), never as a shuffle join on ``tag_id``.  Pages
are taken with ``TakeOrderedAndProject`` before enrichment, so only
≤ 500 rows meet the bridge (J5).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_iso

MAX_PAGE = 500
DEFAULT_PAGE = 50

FEED_COLUMNS = ("id", "title", "summary", "link", "published", "updated", "source", "og_image")
TAG_PAGE_COLUMNS = ("id", "title", "summary", "link", "published", "updated", "created_at")


#: Rows of a tag table up to which it is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (a count that
    stops there); a larger one is left to the planner and its skew join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- arguments

def check_page_args(limit: int, offset: int) -> None:
    """0 <= limit <= 500, offset >= 0 (negative limits rejected, Q7)."""
    if not isinstance(limit, int) or limit < 0 or limit > MAX_PAGE:
        raise ValueError(f"limit must be an integer in [0, {MAX_PAGE}], got {limit!r}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError(f"offset must be a non-negative integer, got {offset!r}")


def normalise_tag_filter(tag: str | Sequence[str] | None) -> list[str]:
    """None or '' means no filter; a list means any-of."""
    if tag is None:
        return []
    names = [tag] if isinstance(tag, str) else list(tag)
    return [t for t in dict.fromkeys(names) if t]


# ---------------------------------------------------------------- counts

def tag_counts(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """A1 (J2): every tag with its article count, zero included; O3 order."""
    per_tag = article_tags.groupBy("tag_id").agg(F.count("article_id").alias("n"))
    return (tags.join(per_tag, tags.id == per_tag.tag_id, "left")
            .select(tags.name.alias("name"),
                    F.coalesce(per_tag.n, F.lit(0)).alias("article_count"))
            .orderBy(F.desc("article_count"), F.asc("name")))


def tag_counts_kept(tags: DataFrame, counts: DataFrame) -> DataFrame:
    """A1 from kept counts (``store.kept_tag_counts``): the same rows, without
    reading the bridge."""
    return (tags.join(counts, tags.id == counts.tag_id, "left")
            .select(tags.name.alias("name"), F.coalesce(counts.n, F.lit(0)).cast("long").alias("article_count"))
            .orderBy(F.desc("article_count"), F.asc("name")))


def popular_tags(tags: DataFrame, article_tags: DataFrame, limit: int = 10) -> DataFrame:
    """A2/O4 (J3): tags used at least once, count desc, name asc, top ``limit``."""
    per_tag = article_tags.groupBy("tag_id").agg(F.count("article_id").alias("n"))
    return (tags.join(per_tag, tags.id == per_tag.tag_id, "inner")
            .select(tags.name.alias("name"), per_tag.n.alias("article_count"))
            .orderBy(F.desc("article_count"), F.asc("name"))
            .limit(limit))


def table_counts(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
                 embeddings: DataFrame | None = None) -> DataFrame:
    """A3: one row per table with its row count."""
    parts = [articles.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("articles").alias("table_name"), "n_rows"),
             tags.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("tags").alias("table_name"), "n_rows"),
             article_tags.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("article_tags").alias("table_name"), "n_rows")]
    if embeddings is not None:
        parts.append(embeddings.agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit("article_embeddings").alias("table_name"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(articles: DataFrame) -> DataFrame:
    """A3 health form: status and article count."""
    return articles.agg(F.count(F.lit(1)).alias("article_count")) \
        .select(F.lit("healthy").alias("status"), "article_count")


# ---------------------------------------------------------------- tag filters

def tag_ids_for(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ids of the named tags (exact, case-sensitive).

    ``name`` is UNIQUE, so the result has at most ``len(names)`` rows: that
    bound is what makes the broadcast below safe."""
    cond = (F.col("name") == F.lit(names[0])) if len(names) == 1 else F.col("name").isin(*names)
    return F.broadcast(tags.where(cond).select(F.col("id").alias("tag_id")))


def article_ids_with_tags(tags: DataFrame, article_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Article ids carrying any of ``names`` (J1 inner part, no duplicates)."""
    hits = article_tags.join(tag_ids_for(tags, names), "tag_id", "left_semi")
    if len(names) > 1:
        hits = hits.select("article_id").distinct()
    return hits.select(F.col("article_id").alias("id"))


def articles_by_tag(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
                    tag: str) -> DataFrame:
    """J1 + P15 + O1: every article with ``tag``, newest first (ties by id)."""
    ids = article_ids_with_tags(tags, article_tags, [tag])
    return (articles.join(ids, "id", "left_semi")
            .select(*TAG_PAGE_COLUMNS)
            .orderBy(F.desc("created_at"), F.asc("id")))


def filter_by_tags(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
                   tag: str | Sequence[str] | None) -> DataFrame:
    """P6 + P7 + A6: optional any-of tag filter as a semi join (no DISTINCT needed)."""
    names = normalise_tag_filter(tag)
    if not names:
        return articles
    return articles.join(article_ids_with_tags(tags, article_tags, names), "id", "left_semi")


# ---------------------------------------------------------------- tags per article

def tags_per_article(tags: DataFrame, article_tags: DataFrame,
                     article_ids: DataFrame | None = None) -> DataFrame:
    """A5 (J3 per article): ``(article_id, tags array<string>)`` sorted by name.

    Per-article lists are bounded by the vocabulary size.  When
    ``article_ids`` is given (a page), the bridge is semi-joined to it
    first."""
    bridge = article_tags.select("article_id", "tag_id")
    if article_ids is not None:
        bridge = bridge.join(article_ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    # with a vocabulary of a checked size a hot tag_id never shuffles
    named = bridge.join(small(tags.select(F.col("id").alias("tag_id"), "name")), "tag_id")
    return named.groupBy("article_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))


def denormalised_feed(articles: DataFrame, tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """A5 over the whole store: the README's single ``feed`` table with
    ``tags array<string>`` (never null)."""
    per = tags_per_article(tags, article_tags)
    return (articles.join(per, articles.id == per.article_id, "left")
            .select(*[articles[c] for c in articles.columns],
                    F.coalesce(per.tags, F.array().cast("array<string>")).alias("tags")))


def feed_with_tag(feed: DataFrame, tag: str) -> DataFrame:
    """``select * from feed where tags contains tag``."""
    return feed.where(F.array_contains("tags", tag))


def feed_tag_counts(feed: DataFrame) -> DataFrame:
    """A4: count per tag on the denormalised feed (the README query, per tag)."""
    return (feed.select(F.explode("tags").alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def distinct_used_tag_ids(article_tags: DataFrame) -> DataFrame:
    """Distinct tag ids in the bridge (partial aggregation per task)."""
    return article_tags.select("tag_id").distinct()


# ---------------------------------------------------------------- pages

def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.asc("id"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """A page is at most 500 rows: write it to the shared checkpoint folder so
    that the enrichment join reuses it instead of re-running the top-k."""
    from feedloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: An offset from here on is found by counts; ranges counted at once; rows that
#: a range is narrowed down to where its values allow.
DEEP_OFFSET, RANGES, RANGE_ROWS = 10_000, 4096, 10_000


def _page_keys(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
               tag, limit: int, offset: int) -> DataFrame:
    """The page's ``(id, created_at)`` only: the tag join and the top-k never
    carry article text (a popular tag may cover a third of the store)."""
    keys = filter_by_tags(articles.select("id", "created_at"), tags, article_tags, tag)
    if offset >= DEEP_OFFSET:
        keys, offset = range_of_page(keys, limit, offset)
    ordered = _newest_first(keys)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def _place_of(keys: DataFrame, position: int, range_rows: int, ranges: int):
    """A short range around the row at ``position`` (newest first, from 0): its
    instants (lowest, highest, in microseconds), its ids if it is a part of one
    instant, the rows before it and its own."""
    rows, before, bounds = keys, 0, []
    at = lambda m: F.timestamp_micros(F.lit(m)).cast(keys.schema["created_at"].dataType)
    for value, newest in ((F.unix_micros(F.col("created_at").cast("timestamp")), True), (F.col("id"), False)):
        while True:
            least, most, n = rows.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
            if n <= range_rows or least == most:
                break
            width = -(-(most - least + 1) // ranges)
            bucket = F.floor((value - F.lit(least)) / F.lit(width)).cast("long")
            counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
            for b, c in sorted(((r.b, r.n) for r in counts), reverse=newest):
                if before + c > position:
                    break
                before += c
            first, last = least + b * width, least + (b + 1) * width - 1
            # on the column itself, so that the predicate reaches the Parquet scan
            rows = rows.where(F.col("created_at").between(at(first), at(last)) if newest else value.between(first, last))
        bounds.append((least, most))
        if n <= range_rows:
            break
    return bounds[0], bounds[1] if len(bounds) > 1 else None, before, n


def range_of_page(keys: DataFrame, limit: int, offset: int, range_rows: int = RANGE_ROWS,
                  ranges: int = RANGES) -> tuple[DataFrame, int]:
    """The part of ``keys`` (id, created_at) that holds the page, and the page's
    offset in it.

    Rows are counted per range of ``created_at``, newest first, and the running
    sum names the range of the page's first row; it is counted again in finer
    ranges until few rows are left, ties within one instant by ranges of ``id``.
    The page's last row is found alike.  A count passes at most ``ranges`` rows to
    the driver, and only what lies between the two is sorted."""
    total = keys.count()
    if offset >= total or limit <= 0:
        return keys.limit(0), 0
    last = min(offset + limit, total) - 1
    start = end = _place_of(keys, offset, range_rows, ranges)
    if last >= start[2] + start[3]:
        end = _place_of(keys, last, range_rows, ranges)
    created, at = F.col("created_at"), lambda m: F.timestamp_micros(F.lit(m)).cast(keys.schema["created_at"].dataType)
    part = keys.where(created.between(at(end[0][0]), at(start[0][1])))
    if start[1]:
        part = part.where((created != at(start[0][0])) | (F.col("id") >= start[1][0]))
    if end[1]:
        part = part.where((created != at(end[0][0])) | (F.col("id") <= end[1][1]))
    return part, offset - start[2]


def _page_rows(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
               tag, limit: int, offset: int) -> DataFrame:
    """Late materialisation: the ≤ offset+limit page keys (a bounded set,
    checkpointed) are broadcast into a plain scan of the articles for their
    full rows."""
    keys = _checkpointed(_page_keys(articles, tags, article_tags, tag, limit, offset))
    return articles.join(F.broadcast(keys.select("id")), "id", "left_semi") \
        .select(*FEED_COLUMNS, "created_at")


def feed_page(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
              tag: str | Sequence[str] | None = None, limit: int = DEFAULT_PAGE,
              offset: int = 0, parse_dates: bool = True) -> DataFrame:
    """GET /articles: P6/P7 -> J1 -> A6 -> O1 -> O2 -> J5/A5 -> F5 -> P14.

    Returns the page with ``created_at`` kept for order, ``tags`` always an
    array (all tags of each article, not only the filtered one)."""
    check_page_args(limit, offset)
    page = _checkpointed(_page_rows(articles, tags, article_tags, tag, limit, offset))
    per = tags_per_article(tags, article_tags, page.select("id"))
    out = page.join(F.broadcast(per), page["id"] == per["article_id"], "left").select(
        page["id"], page["title"], page["summary"], page["link"],
        (parse_iso(page["published"]) if parse_dates else page["published"]).alias("published"),
        (parse_iso(page["updated"]) if parse_dates else page["updated"]).alias("updated"),
        page["source"], page["og_image"], page["created_at"],
        F.coalesce(per.tags, F.array().cast("array<string>")).alias("tags"))
    return _newest_first(out)


def feed_document(page: DataFrame) -> DataFrame:
    """One page as one JSON object ``{"articles": [...]}`` in page order."""
    ordered = page.withColumn("_rank", F.row_number().over(
        Window.orderBy(F.desc("created_at"), F.asc("id"))))
    item = F.struct(
        F.col("_rank"),
        F.struct(
            "title", "summary", "link",
            F.date_format("published", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("published"),
            F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("updated"),
            "source", "og_image", "tags").alias("a"))
    doc = ordered.agg(F.array_sort(F.collect_list(item)).alias("items"))
    return doc.select(
        F.size("items").alias("n_articles"),
        F.to_json(F.struct(F.transform("items", lambda x: x["a"]).alias("articles")),
                  {"ignoreNullFields": "false"}).alias("document"))


def page_with_more(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
                   tag: str | None = None, page_size: int = 10, offset: int = 0) -> DataFrame:
    """A page plus ``has_more`` from fetching ``page_size + 1`` rows (no
    empty trailing page as a full-page test would give)."""
    check_page_args(page_size, offset)
    peek = _checkpointed(_page_rows(articles, tags, article_tags, tag, page_size + 1, offset))
    w = Window.orderBy(F.desc("created_at"), F.asc("id"))
    ranked = peek.withColumn("_r", F.row_number().over(w)) \
        .withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > page_size)
    return ranked.where(F.col("_r") <= page_size).drop("_r")


def keyset_after(df: DataFrame, created_at, last_id: int) -> DataFrame:
    """Deep paging without OFFSET: rows strictly after ``(created_at, id)`` in
    newest-first order; the predicate reaches the Parquet scan."""
    c = F.lit(created_at)
    return df.where((F.col("created_at") < c) |
                    ((F.col("created_at") == c) & (F.col("id") > F.lit(last_id))))


# ---------------------------------------------------------------- projections

def card_projection(feed: DataFrame, default_image: str = "/static/placeholder.svg") -> DataFrame:
    """Default image when none; 'Unknown date' when no date; fixed format."""
    return feed.select(
        "id", "title", "summary", "link", "source", "tags",
        F.coalesce("og_image", F.lit(default_image)).alias("image"),
        F.coalesce(F.date_format(parse_iso(F.col("published")), "M/d/yyyy"),
                   F.lit("Unknown date")).alias("published_display"))


# ---------------------------------------------------------------- report

def top_tag_sample(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
                   n: int = 3, preview: int = 60) -> DataFrame:
    """First ``n`` articles of the most popular tag, with title previews."""
    top = popular_tags(tags, article_tags, 1).select(F.col("name").alias("top_tag"))
    best = tags.join(top, tags.name == top.top_tag).select(F.col("id").alias("tag_id"), "top_tag")
    return _newest_of_tag(articles, article_tags, best, n, preview)


def _newest_of_tag(articles: DataFrame, article_tags: DataFrame, best: DataFrame, n: int, preview: int) -> DataFrame:
    """The newest ``n`` articles of the one tag in ``best`` (tag_id, top_tag)."""
    hits = article_tags.join(F.broadcast(best), "tag_id").select(F.col("article_id").alias("id"), "top_tag")
    # late materialisation: the join and top-n on (id, created_at), titles
    # fetched for the n chosen ids only
    keys = _checkpointed(articles.select("id", "created_at").join(hits, "id")
                         .orderBy(F.desc("created_at"), F.asc("id")).limit(n))
    return (articles.select("id", "title").join(F.broadcast(keys), "id")
            .select("top_tag", "id", F.substring("title", 1, preview).alias("title_preview"), "created_at")
            .orderBy(F.desc("created_at"), F.asc("id")))


def run_report(articles: DataFrame, tags: DataFrame, article_tags: DataFrame,
               top_n: int = 5, sample: int = 3) -> DataFrame:
    """One table with the report's lines: tag count total, top tags,
    article count of the top tag and its sample titles."""
    # the bridge is counted once: a row per tag, written
    used = article_tags.groupBy("tag_id").agg(F.count("article_id").alias("n"))
    counts = _checkpointed(tags.join(used, tags.id == used.tag_id, "left").select(
        "id", "name", F.coalesce("n", F.lit(0)).alias("article_count")))
    n_tags = counts.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("unique_tags").alias("item"), F.lit(None).cast("string").alias("label"),
        F.col("value").cast("long").alias("value"), F.lit(0).alias("rank"))
    w = Window.orderBy(F.desc("article_count"), F.asc("name"))
    ranked = counts.where("article_count > 0").orderBy(F.desc("article_count"), F.asc("name")).limit(max(top_n, 1))
    ranked = _checkpointed(ranked.select("id", "name", "article_count", F.row_number().over(w).alias("rank")))
    top = ranked.where(F.col("rank") <= top_n).select(F.lit("top_tag").alias("item"), F.col("name").alias("label"),
                                                      F.col("article_count").cast("long").alias("value"), "rank")
    best = ranked.where("rank = 1").select(F.col("id").alias("tag_id"), F.col("name").alias("top_tag"))
    sample_rows = _newest_of_tag(articles, article_tags, best, sample, 60).select(
        F.lit("sample_title").alias("item"), F.col("title_preview").alias("label"),
        F.col("id").alias("value"),
        F.row_number().over(Window.orderBy(F.desc("created_at"), F.asc("id"))).alias("rank"))
    return n_tags.unionByName(top).unionByName(sample_rows)
