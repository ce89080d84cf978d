"""Registered queries: one per operator of the inventory, keyed by its ID.

Every query reads the driver tables (or views Spark derives from them)
whole; limits appear only where paging or top-k is the feature.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import feed as FD
from feedloom.plans.fixture_store import fixture_store
from feedloom.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def max_over(df: DataFrame, col: str, divisor: int) -> float:
    """One scalar (``max(col) / divisor``) for splitting a fixture: a single
    number reaches the driver and the split is a plain filter on the scan."""
    v = df.agg(F.max(col)).first()[0]
    return (float(v) if v is not None else 0.0) / divisor


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ feed reads

@register("A1_tag_counts")
def a1_tag_counts(spark, sf):
    s = fixture_store(spark, sf)
    return FD.tag_counts(s.tags, s.article_tags)


@register("A2_popular_tags")
def a2_popular_tags(spark, sf):
    s = fixture_store(spark, sf)
    return FD.popular_tags(s.tags, s.article_tags, 10)


@register("A3_table_counts")
def a3_table_counts(spark, sf):
    s = fixture_store(spark, sf)
    from feedloom.sources.tables import fx_vectors
    return FD.table_counts(s.articles, s.tags, s.article_tags, fx_vectors(spark, sf))


@register("A3_health")
def a3_health(spark, sf):
    return FD.health(fixture_store(spark, sf).articles)


@register("A4_feed_tag_counts")
def a4_feed_tag_counts(spark, sf):
    s = fixture_store(spark, sf)
    return FD.feed_tag_counts(FD.denormalised_feed(*s))


@register("A5_tags_per_article")
def a5_tags_per_article(spark, sf):
    s = fixture_store(spark, sf)
    return FD.denormalised_feed(*s).select("id", "tags")


@register("A7_distinct_tag_ids")
def a7_distinct_tag_ids(spark, sf):
    return FD.distinct_used_tag_ids(fixture_store(spark, sf).article_tags)


@register("J1_articles_by_tag")
def j1_articles_by_tag(spark, sf):
    s = fixture_store(spark, sf)
    return FD.articles_by_tag(s.articles, s.tags, s.article_tags, "Technology")


@register("P7_any_of_tags")
def p7_any_of_tags(spark, sf):
    s = fixture_store(spark, sf)
    return FD.filter_by_tags(s.articles, s.tags, s.article_tags,
                             ["Startups", "Artificial Intelligence"]).select(*FD.FEED_COLUMNS)


@register("P8_feed_contains_tag")
def p8_feed_contains_tag(spark, sf):
    s = fixture_store(spark, sf)
    return FD.feed_with_tag(FD.denormalised_feed(*s), "Artificial Intelligence") \
        .select("id", "link", "tags")


@register("O2_feed_page")
def o2_feed_page(spark, sf):
    s = fixture_store(spark, sf)
    return FD.feed_page(s.articles, s.tags, s.article_tags, None, limit=50, offset=100)


@register("J5_feed_page_by_tag")
def j5_feed_page_by_tag(spark, sf):
    s = fixture_store(spark, sf)
    return FD.feed_page(s.articles, s.tags, s.article_tags, "Startups", limit=500, offset=20)


@register("O8_page_walk")
def o8_page_walk(spark, sf):
    s = fixture_store(spark, sf)
    return FD.page_with_more(s.articles, s.tags, s.article_tags, "Artificial Intelligence",
                             page_size=10, offset=30)


@register("S12_feed_document")
def s12_feed_document(spark, sf):
    s = fixture_store(spark, sf)
    return FD.feed_document(FD.feed_page(s.articles, s.tags, s.article_tags, "Technology",
                                         limit=10, offset=0))


@register("P17_card_projection")
def p17_card_projection(spark, sf):
    s = fixture_store(spark, sf)
    return FD.card_projection(FD.denormalised_feed(*s))


@register("P18_title_preview")
def p18_title_preview(spark, sf):
    a = fixture_store(spark, sf).articles
    return a.select("id", F.substring("title", 1, 60).alias("title_60"),
                    F.substring("title", 1, 50).alias("title_50"))


@register("O7_top_tag_sample")
def o7_top_tag_sample(spark, sf):
    s = fixture_store(spark, sf)
    return FD.top_tag_sample(*s, n=3)


@register("R1_run_report")
def r1_run_report(spark, sf):
    return FD.run_report(*fixture_store(spark, sf))


# ------------------------------------------------------------------ scan and clean

def _entries(spark, sf):
    from feedloom.sources.tables import fx_entries
    return fx_entries(spark, sf)


def _store_links(entries):
    """The fixture's 'store': links of the first quarter of the entries."""
    bound = max_over(entries, "pos", 4)
    return (entries.where(F.col("pos") < F.lit(bound))
            .where(F.col("link").isNotNull()).select("link"))


@register("P1_defaulted_entries")
def p1_defaulted_entries(spark, sf):
    from feedloom.sources.feeds import default_fields
    return default_fields(_entries(spark, sf)).select("pos", "title", "link", "summary")


@register("P2_entries_with_link")
def p2_entries_with_link(spark, sf):
    from feedloom.sources.feeds import default_fields, with_link
    return with_link(default_fields(_entries(spark, sf))).select("pos", "link")


@register("P3_summary_fallback")
def p3_summary_fallback(spark, sf):
    from feedloom.sources.feeds import default_fields, summary_fallback, with_link
    return summary_fallback(with_link(default_fields(_entries(spark, sf)))).select("pos", "summary")


@register("F4_feed_dates")
def f4_feed_dates(spark, sf):
    from feedloom.functions.dates import feed_date_iso
    e = _entries(spark, sf)
    return e.select("pos", "published_raw", feed_date_iso(F.col("published_raw")).alias("published"))


@register("F5_parse_iso")
def f5_parse_iso(spark, sf):
    from feedloom.functions.dates import parse_iso
    a = fixture_store(spark, sf).articles
    return a.select("id", "published", parse_iso(F.col("published")).alias("published_ts"))


@register("F7_url_authority")
def f7_url_authority(spark, sf):
    from feedloom.functions.urls import authority
    from feedloom.sources.tables import load
    p = load(spark, sf, "pages")
    return p.select("page_id", authority(F.col("url")).alias("authority"))


@register("P4_source_names")
def p4_source_names(spark, sf):
    from feedloom.functions.urls import source_name
    e = _entries(spark, sf)
    return e.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entries")) \
        .select("feed_url", source_name(F.col("feed_url")).alias("source"), "entries")


@register("J4_new_links")
def j4_new_links(spark, sf):
    from feedloom.sources.feeds import clean_entries
    e = _entries(spark, sf)
    return clean_entries(e, _store_links(e)).select("pos", "link", "title", "summary",
                                                    "published", "source")


@register("A12_ingest_stats")
def a12_ingest_stats(spark, sf):
    from feedloom.sources.feeds import ingest_stats
    e = _entries(spark, sf)
    # preview images of the links whose path begins with "c"
    images = e.select(F.col("link").alias("url")).where("link like '%/c%'").distinct().withColumn("og_image", F.lit("i.png"))
    return ingest_stats(e, _store_links(e), images)


def _xml_el(tag: str, c):
    esc = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                    F.lit(">"), F.lit("&gt;"))
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{tag}>"), esc, F.lit(f"</{tag}>")))


@register("S1_feed_scan")
def s1_feed_scan(spark, sf):
    """Entries rendered as RSS <item> text, parsed back by the XML reader,
    then cleaned (P1-P3): the scan must give back what was landed."""
    from feedloom.sources.feeds import default_fields, parse_items, summary_fallback, with_link
    e = _entries(spark, sf)
    items = e.select("feed_url", "pos", F.concat(
        F.lit("<item>"), _xml_el("title", F.col("title")), _xml_el("link", F.col("link")),
        _xml_el("description", F.col("summary")), _xml_el("content:encoded", F.col("content")),
        _xml_el("pubDate", F.col("published_raw")), F.lit("</item>")).alias("xml"))
    parsed = parse_items(items)
    out = summary_fallback(with_link(default_fields(parsed)))
    return out.select("pos", "title", "link", "summary", "published_raw")


def _landing_items(e):
    """Entries in the column names of an RSS item."""
    return e.select("pos", "title", "link", F.col("summary").alias("description"), F.col("published_raw").alias("pubDate"))


def _landed(df):
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "link", "summary")]


@register("U1_feed_union")
def u1_feed_union(spark, sf):
    """Two landed feeds that hold all entries between them and share some, in
    one read of the feed list."""
    from feedloom.sources.feeds import read_rss
    from feedloom.streaming.poll import land_rss
    root, e = _fresh_root(spark, "u1-feeds"), _landing_items(_entries(spark, sf))
    land_rss(e.where("pos % 2 = 0"), f"{root}/even")
    land_rss(e.where("pos % 2 = 1 or pos % 3 = 0"), f"{root}/other")
    got = read_rss(spark, [("https://even.example.com/rss", f"{root}/even/*.xml"),
                           ("https://other.example.com/rss", f"{root}/other/*.xml")])
    return got.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entries"),
                                       F.countDistinct(F.coalesce("link", F.lit(""))).alias("links"))


@register("S1_rss_files")
def s1_rss_files(spark, sf):
    """The larger feed is listed first and written as several files: arrival
    order is that of the list, then the place in the feed."""
    from feedloom.sources.feeds import read_rss
    from feedloom.streaming.poll import land_rss, landed_files
    root, e = _fresh_root(spark, "s1-feeds"), _landing_items(_entries(spark, sf))
    large = e.where(F.col("pos") % 4 != 0)
    land_rss(large, f"{root}/a", files=max(3, landed_files(large)))
    land_rss(e.where(F.col("pos") % 4 == 0), f"{root}/b")
    got = read_rss(spark, [("https://large.example.com/rss", f"{root}/a/*.xml"), ("https://small.example.com/rss", f"{root}/b/*.xml")])
    return got.select("feed_url", "pos", *_landed(got))


@register("S1_atom_files")
def s1_atom_files(spark, sf):
    from feedloom.sources.feeds import read_atom
    from feedloom.streaming.poll import landed_files
    e = _entries(spark, sf)
    path = f"{_fresh_root(spark, 'atom-feeds')}/feed"
    link = lambda rel, end: F.struct(F.concat(F.coalesce("link", F.lit("")), F.lit(end)).alias("_href"), F.lit(rel).alias("_rel"))
    (e.repartitionByRange(max(2, landed_files(e)), "pos").sortWithinPartitions("pos")
     .select("title", F.array(link("self", "#self"), link("alternate", "")).alias("link"), "summary")
     .write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path))
    got = read_atom(spark, f"{path}/*.xml")
    return got.select("pos", *_landed(got))


@register("S2_feed_list")
def s2_feed_list(spark, sf):
    """Feeds landed in the folders of their URLs: the URL comes back from the
    path, and with it the source name (P4)."""
    from feedloom.functions.urls import source_name
    from feedloom.sources.feeds import feed_folder, read_rss
    from feedloom.sources.tables import FEED_HOSTS
    from feedloom.streaming.poll import land_rss
    root, e = _fresh_root(spark, "s2-feeds"), _entries(spark, sf)
    urls = [f"https://{h}/rss" for h in FEED_HOSTS]
    for u in urls:
        land_rss(_landing_items(e.where(F.col("feed_url") == u)), root, feed_url=u)
    got = read_rss(spark, [f"{feed_folder(root, u)}/*.xml" for u in urls])
    return got.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entries")).select(
        "feed_url", source_name(F.col("feed_url")).alias("source"), "entries")


# ------------------------------------------------------------------ images and HTML

FIXTURE_BLOCKLIST = ("example.net",)


def _pages(spark, sf):
    from feedloom.sources.tables import fx_pages
    return fx_pages(spark, sf)


@register("F9_preview_image_ref")
def f9_preview_image_ref(spark, sf):
    from feedloom.functions.html import preview_image_ref
    return _pages(spark, sf).select("page_id", preview_image_ref(F.col("html")).alias("image_ref"))


@register("F8_resolve_image")
def f8_resolve_image(spark, sf):
    from feedloom.functions.html import with_image_ref
    from feedloom.functions.urls import resolve_url
    p = with_image_ref(_pages(spark, sf))
    return p.select("page_id", "url", resolve_url(F.col("url"), F.col("image_ref")).alias("og_image"))


@register("P9_blocked_pages")
def p9_blocked_pages(spark, sf):
    from feedloom.operators.images import is_blocked
    p = _pages(spark, sf)
    return p.select("page_id", is_blocked(F.col("url"), FIXTURE_BLOCKLIST).alias("blocked"))


@register("X4_page_images")
def x4_page_images(spark, sf):
    from feedloom.operators.images import page_images
    return page_images(_pages(spark, sf), FIXTURE_BLOCKLIST)


def _grown_blocklist(spark, sf):
    from feedloom.operators.images import grow_blocklist
    from feedloom.sources.tables import load
    p = load(spark, sf, "pages")
    log = p.select("url", F.when(F.col("page_id") % 9 == 0, F.lit(403)).otherwise(F.lit(200)).alias("status"))
    start = spark.createDataFrame([(d,) for d in FIXTURE_BLOCKLIST], "domain string")
    return grow_blocklist(start, log)


@register("X4_grown_blocklist")
def x4_grown_blocklist(spark, sf):
    """The blocklist that the crawl log grew, at work in the image step."""
    from feedloom.operators.images import page_images
    return page_images(_pages(spark, sf), _grown_blocklist(spark, sf))


@register("P11_blank_urls")
def p11_blank_urls(spark, sf):
    from feedloom.operators.images import page_images
    p = _pages(spark, sf)
    blank = F.when(F.col("page_id") % 10 == 0, F.lit("")).when(F.col("page_id") % 10 == 5, F.lit("  ")).otherwise(F.col("url"))
    return page_images(p.withColumn("url", blank), FIXTURE_BLOCKLIST)


@register("J6_attach_images")
def j6_attach_images(spark, sf):
    from feedloom.operators.images import attach_images, page_images
    from feedloom.sources.tables import load
    s = fixture_store(spark, sf)
    urls = load(spark, sf, "pages").select((F.col("page_id") + 1).alias("id"), F.col("url").alias("_url"))
    arts = (s.articles.join(urls, "id", "left")
            .select("id", F.coalesce("_url", "link").alias("link")))
    return attach_images(arts, page_images(_pages(spark, sf), FIXTURE_BLOCKLIST))


@register("F10_clean_html")
def f10_clean_html(spark, sf):
    from feedloom.functions.text import clean_html
    from feedloom.sources.tables import load
    p = load(spark, sf, "pages")
    return p.select("page_id", clean_html(F.col("html")).alias("text"))


# ------------------------------------------------------------------ similarity and dedup

# Fixture vectors have no pair >= 0.70, so the vector fixtures are tested at 0.30.
VECTOR_TEST_THRESHOLD = 0.30


def _vectors(spark, sf):
    from feedloom.sources.tables import fx_vectors
    return fx_vectors(spark, sf)


@register("J8_knn_similarity")
def j8_knn_similarity(spark, sf):
    from feedloom.operators.similarity import knn_join
    v = _vectors(spark, sf)
    nn = knn_join(v, v, 20, VECTOR_TEST_THRESHOLD)
    return nn.select(F.col("x").alias("article_id"), F.col("y").alias("neighbour_id"),
                     F.round("similarity", 6).alias("similarity"))


@register("J9_nearest_stored")
def j9_nearest_stored(spark, sf):
    from feedloom.operators.similarity import nearest_match
    v = _vectors(spark, sf)
    half = F.lit(max_over(v, "article_id", 2))
    store = v.where(F.col("article_id") <= half).select("article_id", "embedding")
    batch = v.where(F.col("article_id") > half).select("article_id", "embedding")
    m = nearest_match(batch, store, VECTOR_TEST_THRESHOLD)
    return m.select(F.col("x").alias("article_id"), "duplicate_id",
                    F.round("similarity", 6).alias("similarity"))


@register("D2_ingest_dedup")
def d2_ingest_dedup(spark, sf):
    from feedloom.operators.dedup import ingest_dedup
    v = _vectors(spark, sf).withColumn("pos", F.col("article_id"))
    st = ingest_dedup(v, None, VECTOR_TEST_THRESHOLD)
    return st.select("article_id", "accepted", "reason", "duplicate_id", F.round("similarity", 6).alias("similarity"))


@register("D2_ingest_dedup_with_store")
def d2_ingest_dedup_with_store(spark, sf):
    """First fifth of the vectors stored, the rest arrive as one batch."""
    from feedloom.operators.dedup import ingest_dedup
    v = _vectors(spark, sf)
    fifth = F.lit(max_over(v, "article_id", 5))
    store = v.where(F.col("article_id") <= fifth).select("article_id", "embedding")
    batch = (v.where(F.col("article_id") > fifth)
             .select("article_id", "embedding", F.col("article_id").alias("pos")))
    st = ingest_dedup(batch, store, VECTOR_TEST_THRESHOLD)
    return st.select("article_id", "accepted", "reason", "duplicate_id", F.round("similarity", 6).alias("similarity"))


@register("D3_duplicate_groups")
def d3_duplicate_groups(spark, sf):
    from feedloom.operators.dedup import duplicate_groups
    return duplicate_groups(_vectors(spark, sf), None, VECTOR_TEST_THRESHOLD)


@register("D4_group_resolution")
def d4_group_resolution(spark, sf):
    from feedloom.operators.dedup import duplicate_groups, resolve_groups
    g = duplicate_groups(_vectors(spark, sf), None, VECTOR_TEST_THRESHOLD).checkpoint()
    return resolve_groups(g)


@register("D4_removed_articles")
def d4_removed_articles(spark, sf):
    from feedloom.operators.dedup import duplicate_groups, removed_ids, resolve_groups
    g = duplicate_groups(_vectors(spark, sf), None, VECTOR_TEST_THRESHOLD).checkpoint()
    return removed_ids(g, resolve_groups(g).checkpoint())


@register("A14_dedup_summary")
def a14_dedup_summary(spark, sf):
    from feedloom.operators.dedup import dedup_summary, duplicate_groups, removed_ids, resolve_groups
    arts = fixture_store(spark, sf).articles
    v = _vectors(spark, sf).join(arts.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    g = duplicate_groups(v, arts.select("id"), VECTOR_TEST_THRESHOLD).checkpoint()
    r = resolve_groups(g).checkpoint()
    return dedup_summary(arts, v, g, r, removed_ids(g, r))


@register("F1_embed_text")
def f1_embed_text(spark, sf):
    from feedloom.functions.text import embed_text, truncate_chars
    a = fixture_store(spark, sf).articles
    t = truncate_chars(embed_text(F.col("title"), F.col("summary")))
    return a.select("id", F.length(t).alias("n_chars"), F.substring(t, 1, 100).alias("head"),
                    F.md5(t).alias("text_md5"))


@register("X3_embed_sparse")
def x3_embed_sparse(spark, sf):
    from feedloom.functions.text import embed_text
    from feedloom.operators.embed import embed
    a = fixture_store(spark, sf).articles.withColumn("_t", embed_text(F.col("title"), F.col("summary")))
    v = embed(spread(a.select("id", "_t"), "id"), "id", "_t")
    return (v.select(F.col("id").alias("article_id"), F.posexplode("embedding").alias("bucket", "w")).where("w <> 0")
            .select("article_id", F.col("bucket").cast("long").alias("bucket"),
                    F.round(F.col("w").cast("double"), 6).alias("weight")))


@register("D3_text_duplicate_groups")
def d3_text_duplicate_groups(spark, sf):
    """The offline job on text: X3 embeddings of the articles, groups at 0.70."""
    from feedloom.functions.text import embed_text
    from feedloom.operators.dedup import duplicate_groups
    from feedloom.operators.embed import embed
    a = fixture_store(spark, sf).articles.withColumn("_t", embed_text(F.col("title"), F.col("summary")))
    vec = embed(spread(a.select("id", "_t"), "id"), "id", "_t").select(F.col("id").alias("article_id"), "embedding")
    return duplicate_groups(vec, None, 0.70)


# ------------------------------------------------------------------ write path

WRITE_TS = "2024-02-01 00:00:00"


def write_fixture(spark, sf):
    """Store = first half of the articles (with their bridge rows); batch =
    the second half, plus every tenth stored article again with a changed
    title (same link: replaced), plus every fiftieth new one twice.  Batch
    tags come from the rule tagger, plus a padded new tag and a blank one
    on every third row."""
    from feedloom.operators.tagging import FIXTURE_RULES, tag_articles
    s = fixture_store(spark, sf)
    a = s.articles
    half = F.lit(max_over(a, "id", 2))
    store = a.where(F.col("id") <= half)
    newer = a.where(F.col("id") > half)
    fields = ["title", "summary", "link", "published", "updated", "source", "og_image"]
    batch = (newer.select(F.col("id").alias("pos"), *fields)
             .unionByName(store.where(F.col("id") % 10 == 0).select(
                 (F.col("id") + 1_000_000).alias("pos"), F.concat(F.lit("changed "), "title").alias("title"),
                 *fields[1:]))
             .unionByName(newer.where(F.col("id") % 50 == 1).select(
                 (F.col("id") + 2_000_000).alias("pos"), F.concat(F.lit("again "), "title").alias("title"),
                 *fields[1:])))
    batch = tag_articles(batch, FIXTURE_RULES)
    extra = F.when(F.col("pos") % 3 == 0, F.array(F.lit(" New Tag "), F.lit(""))) \
        .otherwise(F.array().cast("array<string>"))
    batch = batch.withColumn("tags", F.concat("tags", extra))
    bridge = s.article_tags.join(store.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return store, s.tags, bridge, batch


def _apply_write(spark, sf, upto: str = "M3"):
    """The write path on the fixture, up to M1, M2 or M3 (each step's ids are
    assigned eagerly, so a query builds only the steps it returns)."""
    from feedloom.operators import mutate as M
    store, tags, bridge, batch = write_fixture(spark, sf)
    new_articles, inserted = M.upsert_articles(store, batch, WRITE_TS)
    if upto == "M1":
        return new_articles, None, None
    new_tags, names = M.get_or_create_tags(tags, inserted, WRITE_TS)
    if upto == "M2":
        return new_articles, new_tags, None
    # asked several times: the texts behind it are tagged once
    new_bridge = M.replace_tag_sets(bridge.checkpoint(), new_articles, names, new_tags, WRITE_TS)
    return new_articles, new_tags, new_bridge


@register("M1_upsert_articles")
def m1_upsert_articles(spark, sf):
    arts, _, _ = _apply_write(spark, sf, "M1")
    return arts.select("id", "link", "title", "created_at")


@register("M2_get_or_create_tags")
def m2_get_or_create_tags(spark, sf):
    _, tags, _ = _apply_write(spark, sf, "M2")
    return tags.select("id", "name")


@register("M3_replace_tag_sets")
def m3_replace_tag_sets(spark, sf):
    _, _, bridge = _apply_write(spark, sf)
    return bridge.select("id", "article_id", "tag_id")


@register("M8_untagged_articles_kept")
def m8_untagged_articles_kept(spark, sf):
    arts, _, bridge = _apply_write(spark, sf)
    return arts.join(bridge.select(F.col("article_id").alias("id")), "id", "left_anti").select("id")


def _nine_deleted(spark, sf):
    s = fixture_store(spark, sf)
    return s.articles.where(F.col("id") % 9 != 0), s.tags, s.article_tags


@register("J11_orphan_bridge_rows")
def j11_orphan_bridge_rows(spark, sf):
    from feedloom.operators.mutate import orphan_bridge_rows
    arts, _, bridge = _nine_deleted(spark, sf)
    return orphan_bridge_rows(bridge, arts).select("article_id", "tag_id")


@register("J12_unused_tags")
def j12_unused_tags(spark, sf):
    from feedloom.operators.mutate import unused_tags
    s = fixture_store(spark, sf)
    return unused_tags(s.tags, s.article_tags.where(F.col("tag_id") != 1)).select("id", "name")


@register("M6_clean_up")
def m6_clean_up(spark, sf):
    """Articles with id % 9 = 0 and every bridge row of tag 3 gone: J11 then J12."""
    from feedloom.operators.mutate import clean_up
    arts, tags, bridge = _nine_deleted(spark, sf)
    kept_bridge, kept_tags = clean_up(arts, tags, bridge.where(F.col("tag_id") != 3))
    per_tag = kept_bridge.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return kept_tags.join(per_tag, kept_tags["id"] == per_tag["tag_id"], "left") \
        .select(kept_tags["id"], "name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@register("S8_constraint_violations")
def s8_constraint_violations(spark, sf):
    from feedloom.operators.mutate import constraint_violations
    s = fixture_store(spark, sf)
    arts = (s.articles
            .withColumn("title", F.when(F.col("id") == 1, F.lit(None).cast("string")).otherwise(F.col("title")))
            .withColumn("link", F.when(F.col("id") == 2, F.concat(F.lit("https://"), F.lit("dup.example.com/x")))
                        .when(F.col("id") == 3, F.lit("https://dup.example.com/x")).otherwise(F.col("link"))))
    # asked three times: the texts behind it are tagged once
    bridge = s.article_tags.select("id", "article_id", "tag_id", "created_at").checkpoint()
    extra = (bridge.orderBy("id").limit(1)
             .unionByName(bridge.orderBy("id").limit(1).withColumn("article_id", F.col("article_id") + F.lit(10_000_000))))
    return constraint_violations(arts, s.tags, bridge.unionByName(extra))


@register("S8_constraints_clean_store")
def s8_constraints_clean_store(spark, sf):
    from feedloom.operators.mutate import constraint_violations
    arts, tags, bridge = _apply_write(spark, sf)
    return constraint_violations(arts, tags, bridge)


@register("S3_article_scan")
def s3_article_scan(spark, sf):
    a = fixture_store(spark, sf).articles
    return a.select("id", "title", "summary", "link", "published")


@register("S5_embedding_upsert")
def s5_embedding_upsert(spark, sf):
    """The first half of the vectors is stored; a batch of every vector,
    its id shifted by two fifths of the range, overwrites the stored ids
    above the shift and adds the rest."""
    from feedloom.operators.mutate import upsert_embeddings
    v = _vectors(spark, sf)
    top = int(max_over(v, "article_id", 1))
    stored = v.where(F.col("article_id") <= F.lit(top / 2))
    src = v.select((F.col("article_id") + F.lit(2 * top // 5)).alias("id"), "embedding")
    new = upsert_embeddings(stored, src)
    return new.select("article_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("e1"),
                      F.size("embedding").alias("dim"))


@register("S6_embedding_lookup")
def s6_embedding_lookup(spark, sf):
    """Vectors of the articles tagged 'Artificial Intelligence' (bulk lookup)."""
    from feedloom.operators.mutate import lookup_embeddings
    s = fixture_store(spark, sf)
    ids = FD.article_ids_with_tags(s.tags, s.article_tags, ["Artificial Intelligence"])
    return lookup_embeddings(_vectors(spark, sf), ids).select("article_id", F.size("embedding").alias("dim"))


@register("S7_embedding_delete")
def s7_embedding_delete(spark, sf):
    from feedloom.operators.dedup import duplicate_groups, removed_ids, resolve_groups
    from feedloom.operators.mutate import delete_embeddings
    v = _vectors(spark, sf)
    g = duplicate_groups(v, None, VECTOR_TEST_THRESHOLD).checkpoint()
    gone = removed_ids(g, resolve_groups(g).checkpoint())
    return delete_embeddings(v, gone).select("article_id")


@register("A13_embedding_coverage")
def a13_embedding_coverage(spark, sf):
    v = _vectors(spark, sf).withColumn(
        "embedding", F.when(F.col("article_id") % 17 == 0, F.lit(None)).otherwise(F.col("embedding")))
    return v.agg(F.count("embedding").alias("with_embedding"), F.count(F.lit(1)).alias("total"))


@register("M7_quarantine")
def m7_quarantine(spark, sf):
    from feedloom.operators.mutate import quarantine_articles
    e = _entries(spark, sf)
    _, bad = quarantine_articles(e)
    return bad.select("pos", "reason")


# ------------------------------------------------------------------ composed jobs

INGEST_TS_1 = "2024-03-01 00:00:00"
INGEST_TS_2 = "2024-03-02 00:00:00"


def article_entries(spark, sf):
    """Feed entries in the ENTRIES shape, one per fixture article (its
    source's feed, arrival order = article id)."""
    a = fixture_store(spark, sf).articles
    a = spread(a, "id")
    return a.select(F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")).alias("feed_url"),
                    F.col("id").alias("pos"), "title", "link", "summary",
                    F.lit(None).cast("string").alias("content"),
                    F.col("published").alias("published_raw"),
                    F.col("updated").alias("updated_raw"))


def _fresh_root(spark, name):
    from feedloom.session import work_dir
    return work_dir(spark, name)


def _one_ingest(spark, sf):
    from feedloom.operators.tagging import FIXTURE_RULES
    from feedloom.plans.ingest import ingest
    from feedloom.sources.store import open_store
    root = _fresh_root(spark, "r2-store")
    res = ingest(spark, root, article_entries(spark, sf), INGEST_TS_1, rules=FIXTURE_RULES)
    return root, res, open_store(spark, root)


@register("R2_ingest_single_run")
def r2_ingest_single_run(spark, sf):
    """Every fixture article arrives in one run into an empty store: J4 ->
    tag (P12) -> embed -> D2 at 0.70 -> M1."""
    _, _, st = _one_ingest(spark, sf)
    return st.articles.select("id", "link", "title", "source")


@register("A11_load_stats")
def a11_load_stats(spark, sf):
    _, res, _ = _one_ingest(spark, sf)
    return res.stats


@register("R2_ingest_two_runs")
def r2_ingest_two_runs(spark, sf):
    """First half of the articles, then all of them again: the second run
    sees only links not stored yet (J4); its duplicate test runs against
    the vectors stored by the first run."""
    from feedloom.operators.tagging import FIXTURE_RULES
    from feedloom.plans.ingest import ingest
    from feedloom.sources.store import open_store
    root = _fresh_root(spark, "r2-store")
    e = article_entries(spark, sf)
    first = e.where(F.col("pos") <= F.lit(max_over(e, "pos", 2)))
    ingest(spark, root, first, INGEST_TS_1, rules=FIXTURE_RULES)
    ingest(spark, root, e, INGEST_TS_2, rules=FIXTURE_RULES)
    st = open_store(spark, root)
    tags = FD.denormalised_feed(st.articles, st.tags, st.article_tags).select("id", "tags")
    return st.articles.join(tags, "id").select("id", "link", "created_at", "tags")


def _fixture_store_root(spark, sf):
    """The fixture store written as one batch of a fresh store root."""
    from feedloom.sources.store import Batch, write_batch
    root = _fresh_root(spark, "d5-store")
    s = fixture_store(spark, sf)
    write_batch(spark, root, Batch("fixture", 1), {"articles": spread(s.articles, "id"), "tags": s.tags, "article_tags": s.article_tags})
    return root


def _dedup_job(spark, sf):
    import datetime as dt
    from feedloom.plans.dedup_job import dedup_store
    root = _fixture_store_root(spark, sf)
    return root, dedup_store(spark, root, dt.datetime(2024, 1, 3, 4, 5, 6))


@register("D5_dedup_job")
def d5_dedup_job(spark, sf):
    """The whole offline job on the fixture store (text vectors, 0.70): A14."""
    _, res = _dedup_job(spark, sf)
    return res.summary


@register("D5_store_after_dedup")
def d5_store_after_dedup(spark, sf):
    """Tag counts of the rewritten store (M5 + M6: unused tags are gone)."""
    from feedloom.sources.store import open_store
    root, _ = _dedup_job(spark, sf)
    st = open_store(spark, root)
    return FD.tag_counts(st.tags, st.article_tags)


@register("S9_snapshot")
def s9_snapshot(spark, sf):
    """The snapshot taken before the rewrite holds the store as it was."""
    from feedloom.sources.store import open_snapshot
    root, res = _dedup_job(spark, sf)
    st = open_snapshot(spark, root, res.snapshot_path)
    n = st.article_tags.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_tags"))
    return (st.articles.join(n, F.col("id") == F.col("article_id"), "left")
            .select("id", "link", F.md5("title").alias("title_md5"), F.coalesce("n_tags", F.lit(0)).alias("n_tags")))


# ------------------------------------------------------------------ incremental

FEED_URL = "https://www.kark.com/rss"


def _polled(spark, root):
    from feedloom.sources.store import open_store
    st = open_store(spark, root)
    tags = FD.denormalised_feed(st.articles, st.tags, st.article_tags).select("id", "tags")
    return st.articles.join(tags, "id").select("id", "link", "created_at", "tags", "source")


@register("T1_stream_poll")
def t1_stream_poll(spark, sf):
    """The two runs of R2_ingest_two_runs as two polls of a landing folder:
    land the first half, poll; land everything again, poll.  Each poll reads
    only the newly landed file; the second one's J4 drops the links stored
    by the first."""
    import datetime as dt
    from feedloom.streaming.poll import land_rss, poll_into_store
    from feedloom.operators.tagging import FIXTURE_RULES
    root = _fresh_root(spark, "t1-store")
    landing = f"{root}/_landing"
    e = _landing_items(article_entries(spark, sf))
    first = e.where(F.col("pos") <= F.lit(max_over(e, "pos", 2)))
    stamps = iter([dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2)])
    for df in (first, e):
        land_rss(df, landing, feed_url=FEED_URL)
        poll_into_store(spark, landing, root, rules=FIXTURE_RULES, clock=lambda: next(stamps))
    return _polled(spark, root)


@register("T2_two_streams")
def t2_two_streams(spark, sf):
    """The same two batches by two streams with checkpoints of their own: both
    begin at batch 0, and neither is taken for the other's."""
    import datetime as dt
    from feedloom.streaming.poll import land_rss, poll_into_store
    from feedloom.operators.tagging import FIXTURE_RULES
    root = _fresh_root(spark, "t2-store")
    e = _landing_items(article_entries(spark, sf))
    first = e.where(F.col("pos") <= F.lit(max_over(e, "pos", 2)))
    stamps = iter([dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2)])
    for name, df in (("a", first), ("b", e)):
        land_rss(df, f"{root}/_landing_{name}", feed_url=FEED_URL)
        poll_into_store(spark, f"{root}/_landing_{name}", root, f"{root}/_ck_{name}", rules=FIXTURE_RULES,
                        clock=lambda: next(stamps))
    return _polled(spark, root)


@register("T2_replay")
def t2_replay(spark, sf):
    """A micro-batch delivered twice under one id leaves what one delivery leaves."""
    import datetime as dt
    from feedloom.sources.store import open_store
    from feedloom.streaming.poll import batch_writer, entry_files, land_rss
    from feedloom.operators.tagging import FIXTURE_RULES
    root = _fresh_root(spark, "t2-replay")
    land_rss(_landing_items(article_entries(spark, sf)), f"{root}/_landing", feed_url=FEED_URL)
    write = batch_writer(spark, root, [], rules=FIXTURE_RULES, clock=lambda: dt.datetime(2024, 3, 1), stream_id="one")
    for _ in range(2):
        write(entry_files(spark, f"{root}/_landing"), 0)
    return open_store(spark, root).articles.select("id", "link")


@register("R2_ingest_with_pages")
def r2_ingest_with_pages(spark, sf):
    """One run with the pages of every fourth article: their preview images."""
    from feedloom.operators.tagging import FIXTURE_RULES
    from feedloom.plans.ingest import ingest
    from feedloom.sources.store import open_store
    root, a = _fresh_root(spark, "r2-pages"), fixture_store(spark, sf).articles
    pages = a.where(F.col("id") % 4 == 0).select(F.col("link").alias("url"), F.concat(
        F.lit('<meta property="og:image" content="https://img.example.com/p'), F.col("id").cast("string"),
        F.lit('.png">')).alias("html"))
    ingest(spark, root, article_entries(spark, sf), INGEST_TS_1, pages=pages, rules=FIXTURE_RULES)
    return open_store(spark, root).articles.select("id", "link", "og_image")


# ------------------------------------------------------------------ request bodies, blocklist, vector text

@register("F13_request_bodies")
def f13_request_bodies(spark, sf):
    """Batches of ten articles as request bodies, read back with from_json:
    the body must carry each batch's articles, in order."""
    from feedloom.operators.tagging import REQUEST_FIELDS, request_bodies
    b = request_bodies(fixture_store(spark, sf).articles)
    schema = "array<struct<" + ", ".join(f"`{c}`: string" for c in REQUEST_FIELDS) + ">>"
    items = F.from_json("body", schema)
    return b.select("batch_no", "n_articles", F.size(items).alias("parsed"),
                    F.element_at(items, 1)["link"].alias("first_link"),
                    F.element_at(items, -1)["link"].alias("last_link"),
                    F.md5(F.array_join(F.transform(items, lambda x: F.concat_ws("|", *(
                        F.coalesce(x[c], F.lit("")) for c in ("title", "summary", "published", "updated", "source", "og_image")))),
                        "\n")).alias("body_md5"))


@register("P10_grow_blocklist")
def p10_grow_blocklist(spark, sf):
    """A crawl log over the pages (every ninth answered 403) grows the blocklist."""
    return _grown_blocklist(spark, sf)


@register("F12_vector_json")
def f12_vector_json(spark, sf):
    """Vectors to JSON text and back: what comes back."""
    from feedloom.operators.embed import vector_from_json, vector_to_json
    v = _vectors(spark, sf).select("article_id", vector_from_json(vector_to_json(F.col("embedding"))).alias("e"))
    one = lambda i: F.round(F.element_at("e", i).cast("double"), 6)
    weighted = F.aggregate(F.transform("e", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return v.select("article_id", F.size("e").alias("dim"), one(1).alias("first"), one(-1).alias("last"),
                    F.round(weighted, 4).alias("weighted"))


@register("F11_normalised")
def f11_normalised(spark, sf):
    """Vectors of another length brought to unit length."""
    from feedloom.operators.embed import l2_normalise
    v = _vectors(spark, sf).select("article_id", F.transform("embedding", lambda x: (x * 3).cast("float")).alias("e"))
    return v.select("article_id", F.round(F.element_at(l2_normalise(F.col("e")), 1).cast("double"), 5).alias("first"))


# ------------------------------------------------------------------ smaller rules

@register("S10_absent_store")
def s10_absent_store(spark, sf):
    from feedloom.sources.store import open_store
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("articles")).select(F.lit(name).alias("store"), "articles")
    absent = open_store(spark, _fresh_root(spark, "absent")).articles
    return count(open_store(spark, _fixture_store_root(spark, sf)).articles, "fixture").unionByName(count(absent, "absent"))


@register("P16_page_arguments")
def p16_page_arguments(spark, sf):
    """Which page arguments are accepted, and the rows that they give."""
    s, out = fixture_store(spark, sf), []
    for limit, offset in ((0, 0), (500, 0), (501, 0), (-1, 0), (10, -1), (10, 5), (500, 150)):
        try:
            n = FD.feed_page(s.articles, s.tags, s.article_tags, None, limit, offset).count()
        except ValueError:
            n = None
        out.append((limit, offset, n is not None, n))
    return spark.createDataFrame(out, "page_limit int, page_offset int, accepted boolean, n_rows long")


@register("U2_failed_batches")
def u2_failed_batches(spark, sf):
    """A model that fails on some batches: their articles are left out."""
    from feedloom.operators.tagging import model_tagger
    call = lambda rows: None if len(rows[0]["title"]) % 3 == 0 else [["Technology"]]
    tagged = model_tagger(fixture_store(spark, sf).articles.select("id", "title"), call, batch_size=1, tries=2)
    return tagged.select("id", F.element_at("tags", 1).alias("tag"))


#: Phrases put into titles so that the default rules have something to find.
PHRASES = ("New AI-powered software.", "AI, startups: what's next", "(Venture capital)", "MACHINE  LEARNING!", "said airtight", "")


@register("X1_default_rules")
def x1_default_rules(spark, sf):
    """The default rules over title and summary of every article, a punctuated
    phrase added to each title."""
    from feedloom.operators.tagging import tag_articles
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") % 6 + 1).cast("int"))
    a = fixture_store(spark, sf).articles.select("id", F.concat("title", F.lit(" "), phrase).alias("title"), "summary")
    return tag_articles(a).select("id", "tags")


#: Two-word phrases of these are a rule table of 1,024 rules.
RULE_WORDS = ("an the re on ti sh er in ha ed es or st en th nd is of and to that was with he at tion be by from ou ea le").split()


@register("X1_many_rules")
def x1_many_rules(spark, sf):
    """A large rule table: every pair of words as a phrase."""
    from feedloom.operators.tagging import tag_articles
    rules = [(i * 32 + j, f"{a} {b}", f" {a} {b} ") for i, a in enumerate(RULE_WORDS) for j, b in enumerate(RULE_WORDS)]
    return tag_articles(fixture_store(spark, sf).articles.select("id", "title", "summary"), rules).select("id", "tags")


@register("X2_blank_text")
def x2_blank_text(spark, sf):
    """Among whole texts, a blank one gives a null vector for its own row only."""
    from feedloom.operators.embed import embed
    text = F.concat(F.lit("x "), "title", F.lit(" "), F.coalesce("summary", F.lit("")))
    a = spread(fixture_store(spark, sf).articles, "id").select(
        "id", F.when(F.col("id") % 20 == 0, F.lit(" \n")).when(F.col("id") % 10 != 0, text).alias("t"))
    return embed(a, "id", "t").select("id", F.col("embedding").isNotNull().alias("has_vector"))


@register("T3_link_state")
def t3_link_state(spark, sf):
    """Entries landed in two polls, each all of them: the state of the first
    poll lets no link pass again in the second."""
    from feedloom.streaming.keyed_state import first_links
    from feedloom.streaming.poll import entry_stream, land_rss
    root, e = _fresh_root(spark, "t3-state"), _landing_items(_entries(spark, sf))
    for _ in range(2):
        land_rss(e, f"{root}/landing")
        rows = entry_stream(spark, f"{root}/landing").where("link <> ''").select("link", "_mtime", "_path", "_block")
        (first_links(rows, ["_mtime", "_path", "_block"]).writeStream.format("parquet").option("checkpointLocation", f"{root}/ck")
         .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return spark.read.parquet(f"{root}/out").groupBy("link").agg(F.count(F.lit(1)).alias("passed"))


@register("T3_vector_state")
def t3_vector_state(spark, sf):
    """Vectors in two polls, the second against the state of the first: together
    the choice is that of one walk over all of them."""
    from feedloom.streaming.keyed_state import VectorState, poll_vectors
    v = _vectors(spark, sf).withColumn("pos", F.col("article_id"))
    half = F.ceil(F.col("article_id") / F.lit(max_over(v, "article_id", 2)))
    state = VectorState.create(spark, _fresh_root(spark, "t3-vectors"), v, threshold=VECTOR_TEST_THRESHOLD)
    out = None
    for n in (1, 2):
        got = poll_vectors(state, v.where(half == n), n)
        out = got if out is None else out.unionByName(got)
    return out.select("article_id", "accepted", "duplicate_id", F.round("similarity", 6).alias("similarity"))


@register("A1_kept_counts")
def a1_kept_counts(spark, sf):
    """The fixture store written in two batches, a third deleting the bridge
    rows of every seventh article: counts kept by the batches."""
    from feedloom.sources import store as ST
    root, s = _fresh_root(spark, "a1-store"), fixture_store(spark, sf)
    bridge = s.article_tags.checkpoint()
    for n, half in ((1, "article_id % 2 = 0"), (2, "article_id % 2 = 1")):
        ST.write_batch(spark, root, ST.Batch("fixture", n), {"article_tags": bridge.where(half)} | ({"tags": s.tags} if n == 1 else {}))
    ST.write_batch(spark, root, ST.Batch("fixture", 3), {}, {"article_tags": bridge.where("article_id % 7 = 0").select("id")})
    return FD.tag_counts_kept(ST.read_table(spark, root, "tags"), ST.kept_tag_counts(spark, root))


@register("O2_deep_page")
def o2_deep_page(spark, sf):
    """A page half-way down a long list with many ties (the orders as stored
    keys), found by counts of ranges."""
    from feedloom.sources.tables import load
    keys = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    part, skip = FD.range_of_page(keys, 100, keys.count() // 2, range_rows=200, ranges=64)
    return part.orderBy(F.desc("created_at"), "id").offset(skip).limit(100)


@register("M7_vectors")
def m7_vectors(spark, sf):
    """Vectors of the wrong length or with odd numbers are set aside with a
    reason, rows without a vector go on."""
    from feedloom.operators.mutate import quarantine_articles
    v, i = _vectors(spark, sf), F.col("article_id") % 50
    odd = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    vec = (F.when(i == 0, F.slice("embedding", 1, 10)).when(i == 1, odd).when(i == 2, F.lit(None))
           .when(i == 3, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    rows = v.select("article_id", F.lit("t").alias("title"), F.concat(F.lit("l"), "article_id").alias("link"), vec.alias("embedding"))
    good, bad = quarantine_articles(rows, 64)
    return good.select("article_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("article_id", "reason"))


@register("T3_stream_links")
def t3_stream_links(spark, sf):
    """Entries landed twice, their links deduplicated by a stream."""
    from feedloom.streaming.poll import dedup_links, entry_stream, land_rss
    root, e = _fresh_root(spark, "t3-links"), _landing_items(_entries(spark, sf))
    for _ in range(2):
        land_rss(e, f"{root}/landing")
    links = entry_stream(spark, f"{root}/landing").select("link").where("link <> ''")
    (dedup_links(links).writeStream.format("parquet").option("checkpointLocation", f"{root}/ck")
     .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return spark.read.parquet(f"{root}/out")


@register("O8_keyset_page")
def o8_keyset_page(spark, sf):
    """The page behind a given row, found by its key instead of an offset."""
    a = fixture_store(spark, sf).articles.select("id", "created_at")
    order = (F.desc("created_at"), F.asc("id"))
    last = a.orderBy(*order).offset(30).limit(1).first()
    return FD.keyset_after(a, last.created_at, last.id).orderBy(*order).limit(25)
