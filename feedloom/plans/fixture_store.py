"""The store-shaped tables used by the registered queries, derived by Spark
from the driver tables (see ``feedloom.sources.tables``)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from feedloom.sources import tables as T


class Store(NamedTuple):
    articles: DataFrame
    tags: DataFrame
    article_tags: DataFrame


def fixture_store(spark: SparkSession, sf_dir: str) -> Store:
    articles = T.fx_articles(spark, sf_dir)
    return Store(articles, T.fx_tags(spark), T.fx_article_tags(spark, sf_dir, articles))
