"""The corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  Rows are filtered or put in order, never
changed; the last stage reads the order of the mix from its files and returns
it as ``position``; rows without an id are kept unless they are toxic or exact
or near copies of rows that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_key
from feedloom.llm.queries import MIX_TARGETS, PIECE_MODEL

#: Near duplicates in the pipeline: five-word shingles, Jaccard 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, (80, 100)


def free_names(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    return [f"_k{i}" for i in range(n + len(taken)) if f"_k{i}" not in taken][:n]


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is among ``kept`` (doc_id,
    text_key), one of each repeated row."""
    a, b = free_names(docs, 2)
    no_id = F.lit(-(1 << 63))
    rows = docs.withColumn(a, F.coalesce("doc_id", no_id)).withColumn(b, text_key(F.col("text")))
    keys = kept.select(F.coalesce("doc_id", no_id).alias(a), F.col("text_key").alias(b))
    return rows.join(keys, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifiers reject go."""
    from feedloom.llm.toxicity import fit, reject
    return reject(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    from feedloom.llm.exact_dedup import exact_dedup
    return keep_rows(docs, exact_dedup(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: the smallest id, null
    last, and of equal ids the smallest text key."""
    from feedloom.llm.ngram_join import ngram_join
    found = ngram_join(docs, NEAR_WORDS, NEAR_SIMILARITY)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = found.where("component is not null").groupBy("component").agg(first.alias("k")).select("k.doc_id", "k.text_key")
    return keep_rows(docs, kept.unionByName(found.where("component is null").select("doc_id", "text_key")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mix (files and rows in them)."""
    from feedloom.llm.mixing import mix
    carried = {f"_c{i}": F.col(c) for i, c in enumerate(docs.columns)}
    order = mix(docs, MIX_TARGETS, tie=text_key(F.col("text")), extra=carried)
    return (order.repartitionByRange("position").sortWithinPartitions("position")
            .select(*(F.col(k).alias(c) for k, c in zip(carried, docs.columns))))


def in_file_order(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` as read from the Parquet files of one write, and each row's
    number (from 0) in the order in which its files and rows were written.  A
    scan packs files by length, so its own order says nothing."""
    file, row, before, n = free_names(docs, 4)
    rows = docs.select("*", docs.metadataColumn("_metadata").getField("file_name").alias(file),
                       docs.metadataColumn("_metadata").getField("row_index").alias(row))
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("long")
    earlier = Window.orderBy(number(r"^part-(\d+)-"), number(r"-c(\d+)\."), file).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    files = rows.groupBy(file).agg(F.count(F.lit(1)).alias(n)).select(
        file, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    return rows.join(F.broadcast(files), file), F.col(before) + F.col(row)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and its position in the mix."""
    from feedloom.llm.pieces import encode_decode
    rows, position = in_file_order(docs)
    return encode_decode(rows, PIECE_MODEL, extra={"position": position})


STAGES = [
    ("toxicity", clean),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", mixed),
    ("SentencePiece", encoded),
]

#: None: trained classifiers, components and pieces are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), "pipeline-" + "-".join(name.lower().split()))
    return docs
