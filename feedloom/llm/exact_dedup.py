"""Operator 4: exact deduplication.

Rows are grouped by a 128-bit content hash (MD5) of the text without white
space.  Of equal texts the row with the most code points stays, then the one
with the smallest id.  Only (id, length, hashes) of a document are shuffled;
the bytes are compared inside groups of two or more: their texts, found in a
second scan through a fixed-size bitmap, are grouped by (hash, bytes), with
map-side combine, so a group of copies sends one text per task.  Texts that
share the 128-bit hash but not the bytes are told apart by a second, 256-bit
digest of the same bytes; should two different texts ever agree in both, the
job stops rather than merge them.

Defined cases: a null text counts as empty; empty texts (or white space alone)
form one group; a null id sorts after every other id; rows repeated with the
same id and text are all returned, ``kept`` marks the id that stays; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import FILTER_BITS, in_bitmap, key_bitmap, stage, text_key, utf8_list

WHITE = b" \t\n\x0b\x0c\r"


def md5_128(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def _low64(h: bytes) -> int:
    return int.from_bytes(h[:8], "little", signed=True)


def content_keys(docs: DataFrame, id_col: str, text_col: str, hash128: Callable[[bytes], bytes]) -> DataFrame:
    """One narrow row per document: id, text key, code points, hash, digest."""
    schema = "doc_id long, text_key long, n_points long, content_hash binary, low64 long, text_sha256 string"

    def keys(batches):
        import pyarrow.compute as pc
        for b in batches:
            norm = [t.translate(None, WHITE) for t in utf8_list(b.column(2))]
            hashes = [hash128(t) for t in norm]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pc.fill_null(pc.utf8_length(b.column(2)), 0).cast(pa.int64()),
                 pa.array(hashes, pa.binary()), pa.array([_low64(h) for h in hashes], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())],
                names=["doc_id", "text_key", "n_points", "content_hash", "low64", "text_sha256"])

    return docs.select(F.col(id_col).cast("long"), text_key(F.col(text_col)),
                       F.col(text_col).cast("string").alias("t")).mapInArrow(keys, schema)


def byte_classes(docs: DataFrame, text_col: str, bitmap: np.ndarray, hash128: Callable[[bytes], bytes]) -> DataFrame:
    """Distinct texts, compared byte by byte, of the hashes in the bitmap:
    (content_hash, text_sha256, n_texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = "content_hash binary, text_sha256 string, norm binary"

    def texts(batches):
        bits = shared.value
        for b in batches:
            norm = [t.translate(None, WHITE) for t in utf8_list(b.column(0))]
            hashes = [hash128(t) for t in norm]
            low = np.array([_low64(h) for h in hashes], dtype=np.int64)
            hit = np.flatnonzero(in_bitmap(bits, low))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashes[i] for i in hit], pa.binary()),
                 pa.array([hashlib.sha256(norm[i]).hexdigest() for i in hit], pa.string()),
                 pa.array([norm[i] for i in hit], pa.binary())],
                names=["content_hash", "text_sha256", "norm"])

    return (docs.select(F.col(text_col).cast("string")).mapInArrow(texts, schema)
            .groupBy("content_hash", "text_sha256", "norm").count()
            .groupBy("content_hash", "text_sha256").agg(F.count(F.lit(1)).alias("n_texts")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash128: Callable[[bytes], bytes] = md5_128, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Return per row: doc_id, text_key, keep_id, group_size, kept, text_sha256."""
    keys = stage(content_keys(docs, id_col, text_col, hash128), "exact-keys")
    again = keys.groupBy("content_hash", "low64").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = byte_classes(docs, text_col, key_bitmap(again, "low64", filter_bits), hash128)
    groups = (keys.groupBy("content_hash", "text_sha256")
              .agg(F.count(F.lit(1)).alias("group_size"),
                   F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                                  F.col("doc_id").alias("id"))).alias("first"))
              .join(classes, ["content_hash", "text_sha256"], "left")
              .select("content_hash", "text_sha256", "group_size", F.col("first.id").alias("keep_id"),
                      F.when(F.coalesce("n_texts", F.lit(1)) == 1, F.lit(1)).otherwise(
                          F.raise_error(F.lit("two different texts agree in both digests"))).alias("n_texts")))
    # written first: a join of two plain tables is one that Spark splits where a
    # group is large (a join with an aggregate in the same stage is not)
    groups = stage(groups, "exact-groups")
    return (keys.join(groups, ["content_hash", "text_sha256"])
            .where("n_texts = 1")
            .select("doc_id", "text_key", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
