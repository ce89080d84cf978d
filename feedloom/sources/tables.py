"""Driver tables and the store-shaped views that Spark derives from them.

The views (``fx_*``) give the reference's record shapes (articles, tags,
bridge rows, raw feed entries, pages with image tags, vectors) over the
driver's Parquet tables, so every query's work grows with those tables.
Each has a DuckDB twin in ``feedloom.oracle`` built from the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.urls import SOURCE_NAMES
from feedloom.operators.tagging import FIXTURE_RULES, rules_frame, tag_articles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Hosts of the fixture feeds: those with a source name, and one without.
FEED_HOSTS = tuple(h for h, _ in SOURCE_NAMES) + ("feed6.example.com",)

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z in epoch seconds


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan that cannot be split (a driver table is one row group) over
    the cores, before heavy work per row; a scan of enough tasks stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores, key)


def _ntz_from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def fx_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles store: ties of ten on created_at; published in four styles.
    Where the summary is null, the title holds the whole text."""
    d = load(spark, sf_dir, "documents")
    minute_iso = F.date_format(F.timestamp_seconds(F.lit(EPOCH_2024) + d.doc_id * 60),
                               "yyyy-MM-dd'T'HH:mm:ss")
    m4, m8 = d.doc_id % 4, d.doc_id % 8
    return d.select(
        (d.doc_id + 1).alias("id"),
        F.when(d.doc_id % 7 == 0, d.text)
         .otherwise(F.substring(F.split_part(d.text, F.lit("\n"), F.lit(1)), 1, 80)).alias("title"),
        F.when(d.doc_id % 7 == 0, F.lit(None).cast("string")).otherwise(d.text).alias("summary"),
        F.concat(F.lit("https://"), d.source, F.lit(".example.com/a/"), d.doc_id.cast("string")).alias("link"),
        F.when(m4 == 0, F.concat(minute_iso, F.lit("Z")))
         .when(m4 == 1, F.concat(minute_iso, F.lit("-06:00")))
         .when(m4 == 2, F.lit(None).cast("string"))
         .when(m8 == 7, F.lit("08:00:00"))
         .otherwise(F.lit("not a date")).alias("published"),
        F.lit(None).cast("string").alias("updated"),
        d.source.alias("source"),
        F.when(d.doc_id % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("https://img.example.com/"), d.doc_id.cast("string"), F.lit(".png")))
         .alias("og_image"),
        _ntz_from_epoch(F.lit(EPOCH_2024) + F.floor(d.doc_id / 10)).alias("created_at"),
    )


def fx_tags(spark: SparkSession) -> DataFrame:
    """Tag dimension: the fixture rule table's (id, name)."""
    return rules_frame(spark, FIXTURE_RULES).select(
        "id", "name", _ntz_from_epoch(F.lit(EPOCH_2024)).alias("created_at"))


def fx_article_tags(spark: SparkSession, sf_dir: str, articles: DataFrame | None = None) -> DataFrame:
    """Bridge rows from the rule tagger over title + summary (X1 applied to the store)."""
    a = articles if articles is not None else fx_articles(spark, sf_dir)
    tagged = tag_articles(spread(a.select("id", "title", "summary", "created_at"), "id"), FIXTURE_RULES,
                          with_ids=True)
    return (tagged
            .select(F.col("id").alias("article_id"), F.explode("tag_ids").alias("tag_id"),
                    "created_at")
            .select((F.col("article_id") * 16 + F.col("tag_id")).alias("id"),
                    "article_id", "tag_id", "created_at"))


def fx_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed entries from ``events``: repeats, missing fields, seven date styles."""
    e = load(spark, sf_dir, "events")
    m8 = e.event_id % 8
    iso = F.date_format(e.ts, "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        F.concat(F.lit("https://"), F.element_at(F.array(*[F.lit(h) for h in FEED_HOSTS]), (e.user_id % 7 + 1).cast("int")),
                 F.lit("/rss")).alias("feed_url"),
        e.event_id.alias("pos"),
        F.when(e.event_id % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(e.event_type, F.lit(" "), e.user_id.cast("string"))).alias("title"),
        F.when(e.event_id % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("https://news.example.com/"), e.user_id.cast("string"),
                             F.lit("/"), e.event_type)).alias("link"),
        F.when(e.event_id % 5 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("value "), F.floor(e.value).cast("string"))).alias("summary"),
        e.props.alias("content"),
        F.when(m8 == 0, F.concat(F.date_format(e.ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
         .when(m8 == 1, F.concat(F.date_format(e.ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
         .when(m8 == 2, F.concat(iso, F.lit("Z")))
         .when(m8 == 4, F.concat(F.date_format(e.ts, "EEEE, dd MMM yy HH:mm:ss"), F.lit(" EST")))
         .when(m8 == 5, F.date_format(e.ts, "HH:mm:ss"))
         .when(m8 == 6, iso)
         .when(m8 == 7, F.concat(iso, F.lit("-06:00")))
         .otherwise(F.lit(None).cast("string")).alias("published_raw"),
        F.lit(None).cast("string").alias("updated_raw"),
    )


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with preview-image meta tags injected by page_id % 7."""
    p = load(spark, sf_dir, "pages")
    pid = p.page_id.cast("string")
    m7 = p.page_id % 7
    inject = (F.when(m7 == 0, F.concat(F.lit('<meta property="og:image" content="https://img.example.com/'), pid, F.lit('.png">')))
              .when(m7 == 1, F.concat(F.lit('<meta content="/img/'), pid, F.lit('.png" property="og:image">')))
              .when(m7 == 2, F.concat(F.lit('<meta property="og:image" content="//cdn.example.com/'), pid, F.lit('.png">')))
              .when(m7 == 3, F.concat(F.lit('<meta property="og:image" content=""><meta name="twitter:image" content="t'), pid, F.lit('.png">')))
              .when(m7 == 4, F.concat(F.lit('<meta property="article:image" content="https://a.example.com/'), pid, F.lit('.png">')))
              .when(m7 == 6, F.concat(F.lit('<meta data-x="a>b" property="og:image" content="/a&#038;b'), pid, F.lit('.png?x=1&gt;2">')))
              .when(m7 == 5, F.lit('<!-- <meta property="og:image" content="/commented.png"> -->'))
              .otherwise(F.lit("")))
    charset = F.lit('<meta charset="utf-8">')
    return p.select("page_id", "url",
                    F.replace(p.html, charset, F.concat(charset, inject)).alias("html"))


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return v.select((v.vec_id + 1).alias("article_id"), v.embedding.alias("embedding"))
