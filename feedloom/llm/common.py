"""Shared helpers: staged tables and a fixed-size membership bitmap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import work_dir

#: Bits of the bitmap that preselects rows by key.  It bounds what reaches the
#: driver and is broadcast (2 MiB) whatever the input; when it fills up, more
#: rows pass and are dropped by the join behind it, none is lost.
FILTER_BITS = 1 << 24


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete the files of staged tables whose last reader has been written."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_key(text: Column) -> Column:
    """64-bit key of a text (null and empty texts differ)."""
    return F.xxhash64(text)


def key_bitmap(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap (uint8 bytes) of the ``long`` keys in ``col``, position = low bits
    of the key.  At most ``bits / 64`` pairs of longs reach the driver."""
    slot = F.pmod(F.col(col), F.lit(bits))
    words = (keys.select(F.floor(slot / 64).cast("long").alias("w"),
                         F.pmod(slot, F.lit(64)).cast("int").alias("b"))
             .groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v")))
    out = np.zeros(bits // 64, dtype=np.int64)
    t = words.toArrow()
    out[t["w"].to_numpy()] = t["v"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key may be among those of the bitmap (never a false no)."""
    pos = keys.astype(np.int64) & np.int64(bitmap.size * 8 - 1)
    return ((bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(bool)


def utf8_list(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b if b is not None else b"" for b in col.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, col: int, max_bytes: int):
    """Cut a batch so that the texts of column ``col`` hold about ``max_bytes``
    per slice (at least one row each)."""
    n = batch.num_rows
    if n == 0:
        return
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
