"""The state of a stream of entries, kept by key.

Two stateful processors (``transformWithState``, state in RocksDB):

* ``first_links``: keyed by link, remembers that a link has come.  The first
  entry of a link passes, later ones do not.  Exact without ``expiry``; with
  it, a link that was not seen for so long is forgotten (the bounded form).
* ``VectorState``: keyed by pivot cell, holds the accepted vectors of a cell.  A
  poll asks the cells that its rows can have a match in and adds what it
  accepted; no other cell is read, and the store's vector table not at all.
  Exact without ``expiry``; with it, vectors are forgotten that long after they
  were added.

The pivots are fixed when the state is made, so a vector's cell never changes.
Which cells a row asks follows from the planes half-way between pivots
(``similarity.cells_within``), which hold for any vector to come.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.operators.dedup import DEFAULT_THRESHOLD, _nearest_before, ingest_dedup
from feedloom.operators.similarity import Layout, Side, _matrix, _sq_dist, cells_within, distance_limit, nearest_cells, vector_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Vectors of a cell kept, and compared, at once.
STATE_ROWS = 1024


def use_keyed_state(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _mode(expiry_seconds: int | None) -> str:
    return "None" if expiry_seconds is None else "ProcessingTime"


# ------------------------------------------------------------------ links

class FirstOfLink(StatefulProcessor):
    """Passes the first row of a link: the earliest of its micro-batch by the
    ``order`` columns, if the link has not come before."""

    def __init__(self, order: list[str], expiry_seconds: int | None):
        self.order, self.ttl = order, None if expiry_seconds is None else expiry_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:        # a hot link is read chunk by chunk, one row is held
            best = pdf.sort_values(self.order, kind="stable").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(self.order, kind="stable").head(1)
        known = self.seen.exists()
        self.seen.update((True,))
        if first is not None and not known:
            yield first

    def close(self) -> None:
        pass


def first_links(stream: DataFrame, order: list[str], expiry_seconds: int | None = None) -> DataFrame:
    """The first row of every link of a stream (all its columns, ``link`` among
    them); ``order`` says which row of a micro-batch is first."""
    use_keyed_state(stream.sparkSession)
    # plain names inside: the rows of a group reach Python as named tuples
    names = {c: f"c{i}" for i, c in enumerate(stream.columns)}
    plain = stream.toDF(*names.values())
    first = plain.groupBy(names["link"]).transformWithStateInPandas(
        FirstOfLink([names[c] for c in order], expiry_seconds), plain.schema, "Append", _mode(expiry_seconds))
    return first.toDF(*stream.columns)


# ------------------------------------------------------------------ vectors

INBOX = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("batch", T.LongType()),
                      T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
ANSWER = "batch long, id long, y long, similarity double"


class CellVectors(StatefulProcessor):
    """Adds vectors to a cell, or answers what it holds nearest to a vector."""

    def __init__(self, threshold: float, expiry_seconds: int | None):
        self.threshold, self.ttl = threshold, None if expiry_seconds is None else expiry_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a row of the state is a chunk of vectors: as many rows as vectors cost a call each
        self.held = handle.getListState("held", "ids binary, vecs binary", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = pdf[pdf["role"] == "add"]
            if len(new):
                ids, vecs = new["id"].to_numpy(np.int64), np.vstack([np.asarray(v, dtype=np.float32) for v in new["vec"]])
                self.held.appendList([(ids[a:a + STATE_ROWS].tobytes(), vecs[a:a + STATE_ROWS].tobytes()) for a in range(0, len(ids), STATE_ROWS)])
            asked = pdf[pdf["role"] == "ask"]
            if len(asked):
                yield from self._answers(asked)

    def _answers(self, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = np.vstack([np.asarray(v, dtype=np.float32) for v in asked["vec"]])
        n, nearest = len(x), _nearest_before(self.threshold)
        best, y = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
        left = Side(np.arange(n), x, np.ones(n, np.int64), np.zeros(n, np.int32))
        for ids, vecs in self._chunks():        # all that is held came before
            out = nearest(Side(ids, vecs, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)), left)
            if out is not None:
                i, j, s = out["id"], out["y"], out["similarity"]
                better = (s > best[i]) | ((s == best[i]) & (j < y[i]))
                best[i[better]], y[i[better]] = s[better], j[better]
        hit = best >= 0
        yield pd.DataFrame({"batch": asked["batch"].to_numpy()[hit], "id": asked["id"].to_numpy()[hit], "y": y[hit], "similarity": best[hit]})

    def _chunks(self):
        for ids, vecs in self.held.get():
            ids = np.frombuffer(bytes(ids), dtype=np.int64)
            yield ids, np.frombuffer(bytes(vecs), dtype=np.float32).reshape(len(ids), -1)

    def close(self) -> None:
        pass


class VectorState:
    """The accepted vectors of a store as keyed state below ``root`` (a shared
    folder): ``pivots``, ``inbox``, ``answers`` and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, root: str, threshold: float = DEFAULT_THRESHOLD, expiry_seconds: int | None = None):
        self.spark, self.root, self.threshold, self.expiry = spark, root.rstrip("/"), threshold, expiry_seconds
        points = np.unique(_matrix(spark.read.parquet(f"{self.root}/pivots").select("vec").toArrow()["vec"].combine_chunks()), axis=0)
        n = len(points)
        apart = np.sqrt(_sq_dist(points, points))
        # cells without a radius: the planes between pivots hold for vectors to come as well
        self.cells = Layout(None, spark.sparkContext.broadcast((points, np.full(n, np.inf), np.ones(n, dtype=np.int64), apart)), None)

    @classmethod
    def create(cls, spark: SparkSession, root: str, vectors: DataFrame, pivots: int = 64, id_col: str = "article_id",
               vec: str = "embedding", **kw) -> "VectorState":
        """New state whose pivots are (at most ``pivots``) of the given vectors."""
        rows = vector_rows(vectors, id_col, vec)
        rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(pivots).select("vec").write.mode("overwrite").parquet(f"{root.rstrip('/')}/pivots")
        return cls(spark, root, **kw)

    def _run(self, rows: DataFrame, role: str, batch: int) -> None:
        sent = rows.select(F.explode("cells").alias("cell"), F.lit(role).alias("role"), F.lit(batch).cast("long").alias("batch"), "id",
                           F.col("vec").cast("array<float>").alias("vec"))
        sent.write.mode("overwrite").parquet(f"{self.root}/inbox/{role}-{batch}")
        use_keyed_state(self.spark)
        stream = self.spark.readStream.schema(INBOX).option("recursiveFileLookup", "true").parquet(f"{self.root}/inbox")
        answers = stream.groupBy("cell").transformWithStateInPandas(
            CellVectors(self.threshold, self.expiry), ANSWER, "Append", _mode(self.expiry))
        (answers.writeStream.format("parquet").partitionBy("batch").option("checkpointLocation", f"{self.root}/state")
         .trigger(availableNow=True).start(f"{self.root}/answers").awaitTermination())

    def ask(self, rows: DataFrame, batch: int, id_col: str = "article_id", vec: str = "embedding") -> DataFrame:
        """Per row that has one: (id, y, similarity), the most similar accepted
        vector at the threshold, ties to the smaller id."""
        self._run(cells_within(vector_rows(rows, id_col, vec), self.cells, distance_limit(self.threshold)), "ask", batch)
        got = self.spark.read.schema(ANSWER).parquet(f"{self.root}/answers").where(F.col("batch") == batch)
        best = F.min(F.struct((-F.col("similarity")).alias("s"), "y", "similarity")).alias("b")
        return got.groupBy("id").agg(best).select("id", "b.y", "b.similarity")

    def add(self, rows: DataFrame, batch: int, id_col: str = "article_id", vec: str = "embedding") -> None:
        """Accepted vectors join their cells."""
        self._run(nearest_cells(vector_rows(rows, id_col, vec), self.cells, 1), "add", batch)


def poll_vectors(state: VectorState, batch: DataFrame, number: int) -> DataFrame:
    """T3 for one poll: ``batch`` (article_id, pos, embedding) against what was
    accepted before and itself, first wins (the columns of ``ingest_dedup``); its
    accepted vectors join the state."""
    batch = batch.select("article_id", "pos", "embedding").checkpoint()
    out = ingest_dedup(batch, None, state.threshold, hits=state.ask(batch, number)).checkpoint()
    state.add(batch.join(out.where("accepted").select("article_id"), "article_id", "left_semi"), number)
    return out
