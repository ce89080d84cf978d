"""Explicit schemas of the store, the raw feed entries and the feed view."""

from pyspark.sql import types as T

ARTICLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("summary", T.StringType(), True),
    T.StructField("link", T.StringType(), False),
    T.StructField("published", T.StringType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("og_image", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

TAGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

ARTICLE_TAGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("article_id", T.LongType(), False),
    T.StructField("tag_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

ARTICLE_EMBEDDINGS = T.StructType([
    T.StructField("article_id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
])

# Raw feed entries, one row per <item>/<entry>, before any cleaning.
ENTRIES = T.StructType([
    T.StructField("feed_url", T.StringType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("published_raw", T.StringType(), True),
    T.StructField("updated_raw", T.StringType(), True),
])

# XML read schemas: RSS 2.0 <item> and Atom <entry>.
RSS_ITEM = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("content:encoded", T.StringType(), True),
    T.StructField("pubDate", T.StringType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])

_TEXT_WITH_ATTRS = T.StructType([
    T.StructField("_VALUE", T.StringType(), True),
    T.StructField("_type", T.StringType(), True),
])

ATOM_ENTRY = T.StructType([
    T.StructField("title", _TEXT_WITH_ATTRS, True),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType(), True),
        T.StructField("_rel", T.StringType(), True),
    ])), True),
    T.StructField("summary", _TEXT_WITH_ATTRS, True),
    T.StructField("content", _TEXT_WITH_ATTRS, True),
    T.StructField("published", T.StringType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])
