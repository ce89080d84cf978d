"""Exact nearest-neighbour joins as streams past tiles.

Spark has no vector join, and a cross join with per-pair expressions is
quadratic *rows*.  Here the right side is laid out in cells around pivots (a
bounded number of its own vectors), and large cells are cut into tiles of about
``block_rows`` vectors (by default as many as ``TILE_BYTES`` hold: a row that
can match anywhere is copied once per tile).  A left row is sent to the cells
that can hold a match, and streams past their tiles: a task holds one tile and a
slice of left rows, does one NumPy matrix product, and returns a bounded result
per row.  A tile is copied only so often that the cores have work.  The product
runs in the precision of the vectors, for long ones over their heads first (a
share of the numbers in another basis, the rest bounded by Cauchy-Schwarz); what
is within the limit, less a bound of the rounding, is measured again in double
precision, a bounded number of pairs at a time.

* A cell is left out for a row where the triangle inequality (distance to the
  pivot less the cell's radius) or the plane half-way between the cell's pivot
  and the row's own puts every vector of it beyond the row's bound.
* The bound of a top-k join is found by a first pass: a row meets the nearest
  cells that hold k vectors, and its k-th best there bounds what the second
  pass looks for.  A similarity threshold bounds all rows alike.  The join is
  exact with or without either.  (Vectors without any structure give no
  pruning; an exact join of those is quadratic work whatever the plan.)
* There is one plan for every size, and no side passes through the driver:
  what does is the pivots and one row of counts per cell.
* Long vectors (``FILED_DIM``) do not travel with the rows that are sent: copied
  once per tile they would be quadratic bytes.  Each is written once, to the
  file of its tile in the shared folder; what is sent is a bitmap of rows of a
  file, and a task reads a tile and the rows that stream past it from there,
  ``SLICE_ROWS`` vectors at a time.  In a join of such a table with itself a pair
  of rows that ask for each other is measured once (``_stream_both``).
* No pair list is made by the top-k join: a task emits at most ``k`` rows per
  left row and tile, and partial results merge through ``WindowGroupLimit``.

Distances are L2 in double precision; the similarity is the reference's
``max(0, 1 - d²/2)`` (cosine for unit vectors, F11).  Top-k is taken by
``(distance, id)`` so ties are deterministic.  A similarity threshold is
applied inside the task: similarity falls as distance grows, so the rows
that pass are a prefix of the sorted neighbours and "top-k then threshold"
equals "threshold then top-k" (exact).
"""

from __future__ import annotations

import dataclasses
import functools
import math
import uuid
import zlib
from typing import Callable, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import file_system, work_dir

#: Rows of a tile, if not given: what these bytes hold, within these bounds.
TILE_BYTES, LEAST_TILE, MOST_TILE = 96 << 20, 4096, 32768
#: Upper bound of the pivots, and so of what reaches the driver and is broadcast.
MAX_PIVOTS = 2048
#: Left rows that stream past one copy of a tile: at least, and at most; rows taken at once.
PART_ROWS, MOST_PART_ROWS, SLICE_ROWS = 8192, 131072, 1024
#: Distances held at once, and numbers of the pairs measured again at once.
PRODUCT, GATHER = 1 << 22, 1 << 20
#: Vectors from this length on are compared by their heads first, which are of blocks of so many numbers.
HALVED_DIM, BLOCK = 256, 16
#: Vectors from this length on are kept in files and sent by file and row.
FILED_DIM = 256
#: Slack of the distance bounds against rounding.
SLACK = 1e-6


def similarity_from_distance(d):
    """F11 on a Column: ``greatest(0, 1 - d*d/2)``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - d * d / F.lit(2.0))


def distance_limit(threshold: float | None) -> float:
    """Largest L2 distance whose similarity is still >= threshold."""
    return math.inf if threshold is None or threshold <= 0 else math.sqrt(max(0.0, 2.0 * (1.0 - threshold)))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as float64."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _vectors(col: pa.Array) -> np.ndarray:
    """Rows of a list column as they are: float32 or float64."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype == np.float32 else flat.astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    an = np.einsum("ij,ij->i", a, a)
    bn = np.einsum("ij,ij->i", b, b)
    d2 = an[:, None] + bn[None, :] - 2.0 * (a @ b.T)
    np.maximum(d2, 0.0, out=d2)
    return d2


def _exact_sq(a_rows: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
    diff = a_rows - b_rows
    return np.einsum("ij,ij->i", diff, diff)


def exact_pairs(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs a[r], b[c] in double precision; GATHER
    numbers of a side are copied at once, however many pairs there are."""
    out, step = np.empty(len(r)), max(1, GATHER // max(1, a.shape[1]))
    for at in range(0, len(r), step):
        out[at:at + step] = _exact_sq(a[r[at:at + step]].astype(np.float64), b[c[at:at + step]].astype(np.float64))
    return out


# ------------------------------------------------------------------ cells

class Layout(NamedTuple):
    """A side laid out in cells: ``rows`` (id, vec, ord, mark, cell), and for
    the tasks and the driver pivots, radius, vectors and tiles of each cell."""
    rows: DataFrame
    shared: object
    cells: DataFrame


def vector_rows(df: DataFrame, id_col: str, vec_col: str, ord_col: Column | None = None, mark: Column | None = None) -> DataFrame:
    """(id, vec, ord, mark) of the rows that have a vector; ``ord`` and ``mark``
    are numbers that the compared sides may use."""
    zero = F.lit(0)
    return df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
        (zero if ord_col is None else ord_col).cast("long").alias("ord"), (zero if mark is None else mark).cast("int").alias("mark"))


def _per_slice(df: DataFrame, vec: str, name: str, kind: T.DataType, fn) -> DataFrame:
    """Add column ``name`` = fn(vectors, batch) computed on slices of rows."""
    schema, filed = T.StructType([*df.schema.fields, T.StructField(name, kind)]), is_filed(df, vec)
    if filed:       # narrow rows: by their number of bytes they would all be one task's
        df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, f"{vec}.file").sortWithinPartitions(f"{vec}.file", f"{vec}.row")

    def run(batches):
        files = _Files()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                col = part.column(part.schema.get_field_index(vec))
                new = fn(files.vectors(col).astype(np.float64) if filed else _matrix(col), part)
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])

    return df.mapInArrow(run, schema)


# ------------------------------------------------------------------ files of vectors

#: Columns of a file.
FILED = ["vec", "id", "ord"]
PLACE = T.StructField("vec", T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.IntegerType())]))


def is_filed(rows: DataFrame, vec: str = "vec") -> bool:
    """Whether the rows name their vectors by file and row."""
    return isinstance(rows.schema[vec].dataType, T.StructType)


def is_wide(rows: DataFrame) -> bool:
    """Whether vectors (``vec``) of this length are kept in files."""
    one = rows.select(F.size("vec").alias("dim")).first()
    return one is not None and one.dim >= FILED_DIM


class _Files:
    """Reads vectors by file and row; the last file and the last of its batches
    are kept."""

    def __init__(self):
        self.name = self.reader = self.batch = self.held = None

    def _batch(self, name: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, ids and ``ord`` of a batch."""
        if name != self.name:
            fs, path = file_system(name)
            self.name, self.reader, self.batch = name, pa.ipc.open_file(fs.open_input_file(path)), None
        if k != self.batch:
            b = self.reader.get_batch(k)
            self.batch, self.held = k, (_vectors(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy())
        return self.held

    def vectors(self, places: pa.StructArray) -> np.ndarray:
        """The vectors of the places, in their order."""
        names, row = places.field("file").dictionary_encode(), places.field("row").to_numpy()
        if not len(row):
            return np.zeros((0, 0))
        file, k = names.indices.to_numpy(), row // SLICE_ROWS
        cut = np.flatnonzero((file[1:] != file[:-1]) | (k[1:] != k[:-1])) + 1
        out = None
        for lo, hi in zip([0, *cut], [*cut, len(row)]):
            held, _, _ = self._batch(names.dictionary[int(file[lo])].as_py(), int(k[lo]))
            if out is None:
                out = np.empty((len(row), held.shape[1]), dtype=held.dtype)
            out[lo:hi] = held[row[lo:hi] - k[lo] * SLICE_ROWS]
        return out

    def numbered(self, name: str, row: np.ndarray, mark: np.ndarray):
        """The rows of a file (in order), batch by batch, each with the number
        of rows before it."""
        cut = np.flatnonzero(np.diff(row // SLICE_ROWS)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(row)]):
            vec, id_, ord_ = self._batch(name, int(row[lo]) // SLICE_ROWS)
            at = row[lo:hi] % SLICE_ROWS
            yield int(lo), Side(id_[at], vec[at], ord_[at], mark[lo:hi])

    def sides(self, name: str, row: np.ndarray, mark: np.ndarray):
        """The rows of a file (in order), batch by batch."""
        return (side for _, side in self.numbered(name, row, mark))

    def side(self, name: str, row: np.ndarray, mark: np.ndarray) -> "Side":
        """The rows of a file (in order) as one; a vector is held once."""
        out = None
        for part in self.sides(name, row, mark):
            if out is None:
                out, n = Side(*(np.empty((len(row), *x.shape[1:]), x.dtype) for x in (part.id, part.vec, part.ord)), mark), 0
            for whole, x in ((out.id, part.id), (out.vec, part.vec), (out.ord, part.ord)):
                whole[n:n + len(x)] = x
            n += len(part.id)
        return out


def in_files(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (id, vec, ord, mark, cell) with the vectors written to a file per
    tile (``cells``: cell, tiles) in the order of ``ord``, ids and ``ord`` beside
    them, and ``vec`` the file and the place in it."""
    folder = work_dir(rows.sparkSession, "vectors")
    schema = T.StructType([PLACE if f.name == "vec" else f for f in rows.schema.fields])
    names = schema.names
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    put = (rows.join(F.broadcast(cells), "cell").select(*names, tile.alias("tile"))
           .repartition("cell", "tile").sortWithinPartitions("cell", "tile", "ord", "id"))

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        last = name = sink = writer = None
        n, waiting = 0, []

        def flush():
            nonlocal waiting
            if waiting:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], names=FILED))
                waiting = []

        def close():
            if writer is not None:
                flush()
                writer.close()
                sink.close()

        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in [*names, "tile"]}
            key = [get[c].to_numpy() for c in ("cell", "tile")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if b.num_rows else np.zeros(0, int)
            for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                if hi > lo and (key[0][lo], key[1][lo]) != last:
                    close()
                    last, n = (key[0][lo], key[1][lo]), 0
                    # a try of its own: a task that runs again does not touch what the first has written
                    name = f"{last[0]}-{last[1]}-{uuid.uuid4().hex[:12]}.arrow"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = pa.ipc.new_file(sink, pa.schema([(c, get[c].type) for c in FILED]), options=pa.ipc.IpcWriteOptions(compression="zstd"))
                while lo < hi:
                    step = min(hi - lo, SLICE_ROWS - n % SLICE_ROWS)
                    waiting.append([get[c].slice(lo, step) for c in FILED])
                    place = pa.StructArray.from_arrays([pa.array([f"{folder}/{name}"] * step), pa.array(np.arange(n, n + step, dtype=np.int32))], ["file", "row"])
                    yield pa.RecordBatch.from_arrays([place if c == "vec" else get[c].slice(lo, step) for c in names], names=names)
                    lo, n = lo + step, n + step
                    if n % SLICE_ROWS == 0:
                        flush()
        close()

    return put.mapInArrow(run, schema).checkpoint()



def tile_rows(dim: int) -> int:
    """Rows of a tile of vectors of this length (as float32)."""
    return min(MOST_TILE, max(LEAST_TILE, TILE_BYTES // (4 * max(1, dim))))


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """(id, vec, ord, mark, cell, r): the cell of the nearest pivot, and how far
    that is."""
    def nearest(x, _):
        d2 = _sq_dist(x, pivots.value)
        at = d2.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(d2[np.arange(len(at)), at]))], ["cell", "r"])

    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    return _per_slice(rows, "vec", "at", kind, nearest).select("id", "vec", "ord", "mark", "at.cell", "at.r")


def lay_out(right: DataFrame, block_rows: int | None = None) -> Layout | None:
    """Cells of ``right`` (id, vec, ord, mark); None if it is empty.  Long
    vectors go to files, and are computed more than once before: give written
    rows."""
    spark = right.sparkSession
    n = right.count()
    one = right.select(F.size("vec").alias("dim")).first()
    dim = one.dim if one else 0
    block_rows = block_rows or tile_rows(dim)
    pieces = min(MAX_PIVOTS, max(-(-n // block_rows), math.ceil(math.sqrt(spark.sparkContext.defaultParallelism))))
    chosen = right.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(pieces).select("vec").toArrow()
    if not chosen.num_rows:
        return None
    points = np.unique(_matrix(chosen["vec"].combine_chunks()), axis=0)     # equal pivots are one
    rows = _placed(right, spark.sparkContext.broadcast(points))
    rows = rows if dim >= FILED_DIM else rows.checkpoint()
    radius, count = np.full(len(points), -math.inf), np.zeros(len(points), dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():     # one row per pivot
        radius[r.cell], count[r.cell] = r.r, r.n
    tiles = [(c, int(-(-m // block_rows))) for c, m in enumerate(count.tolist()) if m]
    cells = spark.createDataFrame(tiles, "cell int, tiles int")
    rows = in_files(rows.drop("r"), cells) if dim >= FILED_DIM else rows.drop("r")
    return Layout(rows, spark.sparkContext.broadcast((points, radius, count, np.sqrt(_sq_dist(points, points)))), cells)


def filed_like(left: DataFrame, at: Layout) -> DataFrame:
    """``left`` (id, vec, ord, mark) with its vectors in files if those of the
    layout are: by the nearest pivot, as many to a file as a tile may have."""
    if not is_filed(at.rows):
        return left
    spark, points = left.sparkSession, at.shared.value[0]
    rows = _placed(left, spark.sparkContext.broadcast(points)).drop("r")
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()        # one row per pivot
    most = tile_rows(points.shape[1])
    return in_files(rows, spark.createDataFrame([(r.cell, -(-r.n // most)) for r in held], "cell int, tiles int")).drop("cell")


def nearest_cells(left: DataFrame, at: Layout, k: int) -> DataFrame:
    """Add ``cells``: the cells of the nearest pivots, up to k vectors in all."""
    shared = at.shared

    def choose(x, _):
        points, _, count, _ = shared.value
        d2 = _sq_dist(x, points)
        d2[:, count == 0] = np.inf
        order = np.argsort(d2, axis=1, kind="stable")
        held = np.cumsum(count[order], axis=1) - count[order]
        return _lists(order, (held < k) & (count[order] > 0))

    return _per_slice(left, "vec", "cells", T.ArrayType(T.IntegerType()), choose)


def cells_within(left: DataFrame, at: Layout, limit: float = math.inf) -> DataFrame:
    """Add ``cells``: the cells that can hold a vector within ``limit``, and
    within ``bound`` if left has that column (null: none is known); those in
    ``seen``, if it has that, are left out."""
    shared = at.shared

    def choose(x, part):
        points, radius, count, apart = shared.value
        d2 = _sq_dist(x, points)
        own = d2.argmin(axis=1)
        near = d2[np.arange(len(x)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((d2 - near[:, None]) / (2 * apart[own]), nan=0.0, posinf=0.0, neginf=0.0)
        least = np.maximum(np.sqrt(d2) - radius, plane)
        most = np.full(len(x), limit)
        names = part.schema.names
        if "bound" in names:
            most = np.minimum(most, np.nan_to_num(part.column(names.index("bound")).to_numpy(zero_copy_only=False), nan=np.inf))
        use = (least <= most[:, None] + SLACK) & (count > 0)
        if "seen" in names:
            seen = part.column(names.index("seen"))
            use[np.repeat(np.arange(len(x)), np.diff(seen.offsets.to_numpy())), seen.flatten().to_numpy()] = False
        return _lists(np.broadcast_to(np.arange(len(points)), use.shape), use)

    return _per_slice(left, "vec", "cells", T.ArrayType(T.IntegerType()), choose)


def _lists(cells: np.ndarray, use: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, cells[use].astype(np.int32))


@dataclasses.dataclass
class Side:
    """Rows of a tile, or of a slice that streams past it."""
    id: np.ndarray
    vec: np.ndarray
    ord: np.ndarray
    mark: np.ndarray
    #: The side that this one is rows of, and the first and last of them.
    of: tuple["Side", int, int] | None = None

    @functools.cached_property
    def sq(self) -> np.ndarray:
        """Squared lengths."""
        return np.einsum("ij,ij->i", self.vec, self.vec, dtype=np.float64)

    @functools.cached_property
    def large(self) -> float:
        """The largest finite squared length."""
        return float(self.sq[np.isfinite(self.sq)].max(initial=0.0))

    def head(self, parts: int) -> np.ndarray:
        """``parts`` numbers of every ``BLOCK`` in another orthonormal basis, the
        length of all the others (not less than it is), one, and minus half the
        squared length: with the last two exchanged on one side, a product of two
        heads is not less than minus half the squared distance.  The basis
        (Hadamard's, of numbers far apart) takes its share of every number, so
        that a head holds about the same share of any two vectors."""
        if self.of is not None:
            side, lo, hi = self.of
            return side.head(parts)[lo:hi]
        held = self.__dict__.setdefault("heads", {})
        if parts not in held:
            n, dim = self.vec.shape
            wide = -(-dim // BLOCK)
            x = self.vec if wide * BLOCK == dim else np.pad(self.vec, ((0, 0), (0, wide * BLOCK - dim)))
            out = np.empty((n, wide * parts + 3), dtype=x.dtype)
            for at in range(0, n, SLICE_ROWS):
                some = x[at:at + SLICE_ROWS].reshape(-1, BLOCK, wide).transpose(0, 2, 1) @ _hadamard(x.dtype.str)[:, 1:parts + 1]
                out[at:at + SLICE_ROWS, :-3] = some.reshape(len(some), -1)
            share = np.einsum("ij,ij->i", out[:, :-3], out[:, :-3], dtype=np.float64)
            out[:, -3] = np.sqrt(np.maximum(self.sq - share, 0.0) + 1e-6 * self.sq)
            out[:, -2], out[:, -1] = 1, self.sq / -2
            held[parts] = out
        return held[parts]

    def between(self, lo: int, hi: int) -> "Side":
        """Rows lo to hi."""
        out = Side(*(x[lo:hi] for x in (self.id, self.vec, self.ord, self.mark)), (self, lo, hi))
        out.sq, out.large = self.sq[lo:hi], self.large
        return out

    def take(self, rows: np.ndarray) -> "Side":
        """A copy of some rows (a mask)."""
        return Side(*(x[rows] for x in (self.id, self.vec, self.ord, self.mark)))

    def first(self, n: int) -> "Side":
        """The first n rows (of a tile: those of the least ``ord``)."""
        return self.between(0, n)


@functools.lru_cache(maxsize=None)
def _hadamard(kind: str) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < BLOCK:
        out = np.block([[out, out], [out, -out]])
    return (out / math.sqrt(BLOCK)).astype(kind)


def _pairs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few pairs."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def _precision(left: Side, tile: Side) -> tuple[np.dtype, float]:
    """The precision of a product, and a bound of the rounding of its squared
    distances."""
    kind = np.promote_types(left.vec.dtype, tile.vec.dtype)
    if left.large + tile.large > 1e30:
        kind = np.dtype(np.float64)
    return kind, max(1e-9, float((left.vec.shape[1] + 64) * np.finfo(kind).eps * (left.large + tile.large)))


def _product(left: Side, tile: Side) -> tuple[np.ndarray, float]:
    """Squared distances in the vectors' own precision, and a bound of their
    rounding."""
    kind, rounding = _precision(left, tile)
    with np.errstate(invalid="ignore", over="ignore"):
        out = left.vec.astype(kind, copy=False) @ tile.vec.astype(kind, copy=False).T
        out *= -2
        out += left.sq.astype(kind)[:, None]
        out += tile.sq.astype(kind)[None, :]
    return out, rounding


def _head_parts(max_d2: float) -> int:
    """Numbers of a block that a head takes: what is left out must hold less than
    the similarity asked for.  (For unit vectors; of others a head may leave
    more pairs open, and no pair is lost.)"""
    return math.ceil(BLOCK * max_d2 / 2 + 2)


def _by_heads(left: Side, tile: Side, max_d2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The pairs that heads leave open and that are within the squared distance,
    rounded; None if they leave open more than a product of all is worth."""
    kind, rounding = _precision(left, tile)
    parts = _head_parts(max_d2)
    with np.errstate(invalid="ignore", over="ignore"):
        x, y = left.head(parts), tile.head(parts)
        x = np.concatenate([x[:, :-2], x[:, :-3:-1]], axis=1)
        open_ = x @ y.T >= -(max_d2 + rounding) / 2
        r, c = _pairs(open_)
        if len(r) > open_.size // 64:
            return None
        d2, step = np.empty(len(r), kind), max(1, GATHER // left.vec.shape[1])
        for at in range(0, len(r), step):
            some = slice(at, at + step)
            d2[some] = np.einsum("ij,ij->i", left.vec[r[some]].astype(kind, copy=False), tile.vec[c[some]].astype(kind, copy=False))
        d2 = left.sq[r] + tile.sq[c] - 2 * d2
        keep = d2 <= max_d2 + rounding
    return r[keep], c[keep], d2[keep]


def close_pairs(left: Side, tile: Side, max_d2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(left row, tile row) of every pair within the squared distance, and some
    that are beyond it by the rounding; their rounded squared distances and the
    bound of the rounding."""
    kind, rounding = _precision(left, tile)
    if left.vec.shape[1] >= HALVED_DIM and left.vec.dtype == tile.vec.dtype == kind and _head_parts(max_d2 if math.isfinite(max_d2) else 2) <= 3 * BLOCK // 4:
        found = _by_heads(left, tile, max_d2)
        if found is not None:
            return *found, rounding
    d2, rounding = _product(left, tile)
    r, c = _pairs(d2 <= max_d2 + rounding)
    return r, c, d2[r, c], rounding


def stream_past(left: DataFrame, at: Layout, fn: Callable[[Side, Side], dict | None], schema: str,
                right: DataFrame | None = None) -> DataFrame:
    """``fn(tile, left rows)`` for every tile of the cells that a left row
    names.  ``left``: id, vec, ord, mark, cells.  ``right`` (rows of the layout,
    perhaps with other marks) takes the place of all its rows.  Tiles come in the
    order of ``ord``, and so do left rows (those in files: file by file).  What ``fn`` returns are columns of
    ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]
    rows = at.rows if right is None else right
    if is_filed(left):
        return _stream_files(left, rows, fn, schema)
    sent = left.select("id", "vec", "ord", "mark", F.explode("cells").alias("cell"))
    spark = left.sparkSession
    # one row per cell
    plan = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(at.cells), "cell").collect()
    per_part = sum(r.n * r.tiles for r in plan) // (4 * spark.sparkContext.defaultParallelism)
    per_part = min(MOST_PART_ROWS, max(PART_ROWS, per_part))
    plan = F.broadcast(spark.createDataFrame([(r.cell, r.tiles, -(-r.n // per_part)) for r in plan], "cell int, tiles int, parts int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    side = lambda n: F.lit(n).alias("side")
    rest = ("id", "vec", "ord", "mark")
    held = rows.join(plan, "cell").select("cell", of("tiles").alias("tile"), upto("parts").alias("part"), side(0), *rest)
    past = sent.join(plan, "cell").select("cell", upto("tiles").alias("tile"), of("parts").alias("part"), side(1), *rest)

    def run(batches):
        tile, held, last = None, [], None
        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(4)]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if b.num_rows else np.zeros(0, int)
            for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                key = tuple(k[lo] for k in keys[:3]) if hi > lo else last
                if key != last:
                    tile, held, last = None, [], key
                if hi > lo and keys[3][lo] == 0:
                    p = [b.column(i).slice(lo, hi - lo) for i in range(4, 8)]
                    held.append((p[0].to_numpy(), _vectors(p[1]).copy(), p[2].to_numpy(), p[3].to_numpy()))
                    continue
                if held:
                    tile, held = Side(*map(np.concatenate, zip(*held))), []
                if tile is None:
                    continue
                step = max(1, min(SLICE_ROWS, PRODUCT // len(tile.id)))
                for a in range(lo, hi, step):
                    p = b.slice(a, min(step, hi - a))
                    out = fn(tile, Side(p.column(4).to_numpy(), _vectors(p.column(5)), p.column(6).to_numpy(), p.column(7).to_numpy()))
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    return (held.unionByName(past).repartition("cell", "tile", "part").sortWithinPartitions("cell", "tile", "part", "side", "ord")
            .mapInArrow(run, schema))


def _stretches(rows: DataFrame, cell: Column) -> DataFrame:
    """(cell, file, bucket, mark, bits, n): the rows of each PART_ROWS of a file
    as a bitmap.  Those of a file are brought together before their cells are
    spread out, so a bitmap is made once."""
    at = F.col("vec.row")
    rows = rows.select(F.col("vec.file").alias("file"), F.floor(at / PART_ROWS).cast("int").alias("bucket"),
                       (at % PART_ROWS).cast("long").alias("bit"), "mark", cell.alias("cells"))
    rows = rows.repartition("file", "bucket").withColumn("cell", F.explode("cells"))
    return rows.groupBy("cell", "file", "bucket", "mark").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("n"))


def _stream_files(left: DataFrame, right: DataFrame, fn: Callable[[Side, Side], dict | None], schema: str) -> DataFrame:
    """``stream_past`` where vectors are in files: a tile is a file, and what is
    sent is a bitmap of the rows of a stretch of a file, once per tile that it
    streams past.  Rows that were sent one by one would be their number times
    that of the tiles, in every round."""
    names = [f.split()[0] for f in schema.split(", ")]
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    held = _stretches(right, F.array("cell")).withColumn("tile", F.col("file")).checkpoint()
    sent = _stretches(left, F.col("cells")).checkpoint()
    tiles = held.select("cell", "tile").distinct()
    met = sent.join(tiles, "cell").agg(F.sum("n")).first()[0] or 0
    several = max(1, min(MOST_PART_ROWS, met // (4 * cores)) // PART_ROWS)
    sent = sent.withColumn("part", F.xxhash64("file", F.floor(F.col("bucket") / F.lit(several))))
    side = lambda n: F.lit(n).alias("side")
    rest = ("file", "bucket", "mark", "bits")
    theirs = held.join(sent.select("cell", "part").distinct(), "cell").select("cell", "tile", "part", side(0), *rest)
    past = sent.join(tiles, "cell").select("cell", "tile", "part", side(1), *rest)
    pairs = past.select("cell", "tile", "part").distinct().count()
    # by their bytes these rows would all be one task's
    number = max(1, min(4 * pairs, max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def run(batches):
        files, tile, of, held, last = _Files(), None, None, [], None

        for b in batches:
            for cell, name, part, at_side, *stretch in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (cell, name, part) != last:
                    held, last = [], (cell, name, part)
                if at_side == 0:
                    held.append(stretch)
                    continue
                if (cell, name) != of:          # the parts that a tile meets follow each other
                    tile = None
                    tile, of = files.side(*_rows_of(held)), (cell, name)
                step = max(1, min(SLICE_ROWS, PRODUCT // len(tile.id)))
                for s in files.sides(*_rows_of([stretch])):
                    for a in range(0, len(s.id), step):
                        out = fn(tile, Side(*(x[a:a + step] for x in (s.id, s.vec, s.ord, s.mark))))
                        if out is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    return (theirs.unionByName(past).repartition(number, "cell", "tile", "part")
            .sortWithinPartitions("cell", "tile", "part", "side", "file", "bucket").mapInArrow(run, schema))


def _rows_of(stretches: list) -> tuple[str, np.ndarray, np.ndarray]:
    """File, rows and marks of the stretches (file, bucket, mark, bits) of one
    file, in order."""
    row = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + bucket * PART_ROWS
           for _, bucket, _, bits in stretches]
    mark = np.repeat(np.array([m for _, _, m, _ in stretches], np.int32), [len(r) for r in row])
    row = np.concatenate(row)
    order = np.argsort(row, kind="stable")
    return stretches[0][0], row[order], mark[order]


# ------------------------------------------------------------------ top-k

def _can_be_nearest(of: np.ndarray, near: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Of the pairs of each row ``of``, those that can be among its nearest k."""
    order = np.lexsort((near, of))
    start = np.flatnonzero(np.diff(of[order], prepend=-1))
    held = np.diff(np.r_[start, len(of)])
    out = np.empty(len(of), bool)
    out[order] = near[order] <= np.repeat(near[order][start + np.minimum(k, held) - 1], held) + slack
    return out


def _nearest(of: np.ndarray, id_: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Places of the nearest k pairs of each row ``of``, ties by id."""
    order = np.lexsort((id_, d2, of))
    start = np.flatnonzero(np.diff(of[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


def _within(exact: np.ndarray, max_d2: float) -> np.ndarray:
    return np.isfinite(exact) & ((1.0 - exact / 2.0) >= (1.0 - max_d2 / 2.0) - 1e-12)


def _topk_fn(k: int | None, max_d2: float | None, exclude_self: bool):
    """Per left row its ``k`` nearest (all, if None) within the limit."""
    def fn(tile: Side, left: Side):
        kk = len(tile.id) if k is None else min(k, len(tile.id))
        if max_d2 is None:
            d2, rounding = _product(left, tile)
            if exclude_self:
                d2[left.id[:, None] == tile.id[None, :]] = np.inf
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
            rows, cols = np.nonzero(d2 <= (kth[:, None] + 2 * rounding))
        else:
            rows, cols, near, rounding = close_pairs(left, tile, max_d2)
            other = left.id[rows] != tile.id[cols] if exclude_self else np.ones(len(rows), bool)
            rows, cols, near = rows[other], cols[other], near[other]
            if len(rows) > kk:
                can = _can_be_nearest(rows, near, kk, 2 * rounding)
                rows, cols = rows[can], cols[can]
        exact = exact_pairs(left.vec, rows, tile.vec, cols)
        if exclude_self:
            exact[left.id[rows] == tile.id[cols]] = np.inf
        keep = np.isfinite(exact) if max_d2 is None else _within(exact, max_d2)
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
        if not len(rows):
            return None
        sel = _nearest(rows, tile.id[cols], exact, kk)
        return {"x": left.id[rows[sel]], "y": tile.id[cols[sel]], "distance": np.sqrt(exact[sel])}

    return fn


class _Reverse:
    """The nearest k left rows of each row of a tile, gathered while left rows
    stream past it: what is held does not grow with them."""

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, of: np.ndarray, id_: np.ndarray, d2: np.ndarray) -> None:
        if len(of):
            self.parts.append((of, id_, d2))
            self.n += len(of)
            if self.n > self.most:
                self.parts = [self.nearest()]
                self.n = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.n)

    def nearest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, id_, d2 = map(np.concatenate, zip(*self.parts))
        sel = _nearest(of, id_, d2, self.k)
        return of[sel], id_[sel], d2[sel]


def _both_ways(left: Side, tile: Side, asked: np.ndarray | None, at: int, k: int, max_d2: float, exclude_self: bool, back: _Reverse) -> dict | None:
    """The nearest k tile rows of each left row, and into ``back`` the left rows
    of those tile rows (numbered from ``at``) that have asked for them: a pair is
    measured once for both."""
    rows, cols, near, rounding = close_pairs(left, tile, max_d2)
    if exclude_self:
        other = left.id[rows] != tile.id[cols]
        rows, cols, near = rows[other], cols[other], near[other]
    if not len(rows):
        return None
    there = _can_be_nearest(rows, near, k, 2 * rounding)
    again = np.zeros(len(rows), bool)
    if asked is not None:
        again = asked[cols]
        again[again] = _can_be_nearest(cols[again], near[again], k, 2 * rounding)
    some = there | again
    rows, cols, there, again = rows[some], cols[some], there[some], again[some]
    exact = exact_pairs(left.vec, rows, tile.vec, cols)
    keep = _within(exact, max_d2)
    again &= keep
    back.add(cols[again] + at, left.id[rows[again]], exact[again])
    there &= keep
    rows, cols, exact = rows[there], cols[there], exact[there]
    if not len(rows):
        return None
    sel = _nearest(rows, tile.id[cols], exact, k)
    return {"x": left.id[rows[sel]], "y": tile.id[cols[sel]], "distance": np.sqrt(exact[sel])}


PAIRS = "x long, y long, distance double"
#: Left rows taken at once where pairs serve both sides, and left rows past a tile that are worth a task.
BOTH_ROWS, TASK_ROWS = 512, 32768


def _stream_both(left: DataFrame, at: Layout, k: int, max_d2: float, exclude_self: bool) -> DataFrame:
    """``stream_past`` of ``_topk_fn`` for rows of the layout itself (in files):
    the same pairs, but two rows that ask for each other are measured once.

    Of two files one streams past the other (which one, a hash of both says) and
    brings back the neighbours of both sides' rows that asked; the other streams
    only past those that did not.  A file streams past itself row by row, every
    row past those behind it.  What is sent are bitmaps, as in ``_stream_files``:
    the rows of a tile, those of it that ask for a cell, and the rows of the
    files of that cell."""
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    held = _stretches(at.rows, F.array("cell")).withColumnRenamed("cell", "own").checkpoint()
    asking = _stretches(left, F.col("cells")).join(held.select("file", "own").distinct(), "file").checkpoint()
    tiles = held.select(F.col("own").alias("cell"), F.col("file").alias("tile")).distinct()
    met = asking.join(tiles, "cell").agg(F.sum("n")).first()[0] or 0
    n_tiles = max(1, tiles.count())
    groups = max(1, -(-max(2 * cores, met // TASK_ROWS) // n_tiles))
    rest = ("file", "bucket", "mark", "bits")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    side = lambda n: F.lit(n).alias("side")
    rows = held.select(F.col("file").alias("tile"), every, side(0), "own", *rest)
    asked = asking.select(F.col("file").alias("tile"), every, side(1), F.col("cell").alias("own"), *rest)
    past = asking.join(tiles, "cell").select("tile", F.pmod(F.xxhash64("file", "bucket"), F.lit(groups)).cast("int").alias("group"),
                                             side(2), "own", *rest)
    names = ["x", "y", "distance"]

    def run(batches):
        files, last = _Files(), None
        tile = loaded = back = others = row = None
        held, asked = [], {}

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

        def returned():
            """What is brought back to the rows of the tile."""
            if back is not None and back.n:
                of, id_, d2 = back.nearest()
                yield batch({"x": tile.id[of], "y": id_, "distance": np.sqrt(d2)})

        def met(left, right, mask, begin):
            step = max(1, PRODUCT // BOTH_ROWS)
            for lo in range(0, len(right.id), step):
                hi = min(lo + step, len(right.id))
                out = _both_ways(left, right.between(lo, hi), None if mask is None else mask[lo:hi], begin + lo, k, max_d2, exclude_self, back)
                if out is not None:
                    yield batch(out)

        for b in batches:
            for name, group, at_side, own, *stretch in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (name, group) != last:
                    yield from returned()
                    last, back, others, held, asked = (name, group), _Reverse(k), None, [], {}
                if at_side == 0:
                    held.append(stretch)
                    continue
                if at_side == 1:
                    asked.setdefault(own, []).append(stretch)
                    continue
                if held:
                    of, row, mark = _rows_of(held)
                    if loaded != name:
                        tile = None
                        tile, loaded = files.side(of, row, mark), name
                    held = []
                    asked = {c: np.isin(row, _rows_of(x)[1]) for c, x in asked.items()}
                if others is None or others[0] != own:
                    others = (own, asked.get(own, np.zeros(len(row), bool)), None)
                _, named, unnamed = others
                first = zlib.crc32("".join(sorted((name, stretch[0]))).encode()) & 1
                chosen = name == stretch[0] or (name > stretch[0]) == bool(first)
                if not chosen and named.all():
                    continue
                if unnamed is None and not named.all() and (not chosen or name == stretch[0]):
                    unnamed = tile.take(~named)
                    others = (own, named, unnamed)
                file, theirs, marks = _rows_of([stretch])
                for lo, s in files.numbered(file, theirs, marks):
                    for a in range(0, len(s.id), BOTH_ROWS):
                        some = s.between(a, min(a + BOTH_ROWS, len(s.id)))
                        if name == file:
                            p, q = (int(np.searchsorted(row, theirs[lo + x])) for x in (a, a + len(some.id) - 1))
                            ask = named[p:].copy()
                            ask[:q + 1 - p] = False
                            yield from met(some, tile.between(p, len(row)), ask, p)
                            before = int((~named[:p]).sum())
                            if before:
                                yield from met(some, unnamed.between(0, before), None, 0)
                        elif chosen:
                            yield from met(some, tile, named, 0)
                        else:
                            yield from met(some, unnamed, None, 0)
        yield from returned()

    number = max(2 * n_tiles * groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (rows.unionByName(asked).unionByName(past).repartition(number, "tile", "group")
            .sortWithinPartitions("tile", "group", "side", "own", "file", "bucket").mapInArrow(run, PAIRS))


def knn_join(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None,
             left_id: str = "article_id", right_id: str = "article_id",
             vec: str = "embedding", exclude_self: bool = False,
             block_rows: int | None = None) -> DataFrame:
    """For every left row its ``k`` nearest right rows by L2 (ties by id),
    then those with similarity >= ``threshold``.  Output
    ``(x, y, distance, similarity)``; null vectors take no part."""
    spark = left.sparkSession
    l, r = vector_rows(left, left_id, vec), vector_rows(right, right_id, vec)
    max_d2 = None if threshold is None or threshold <= 0 else 2.0 * (1.0 - threshold)
    fn, limit = _topk_fn(k, max_d2, exclude_self), distance_limit(threshold)
    at = lay_out(r, block_rows)
    if at is None:
        return spark.createDataFrame([], PAIRS + ", similarity double")
    if is_filed(at.rows):     # of one table one layout serves both sides
        l = at.rows.drop("cell") if left is right and left_id == right_id else filed_like(l, at)
    w = Window.partitionBy("x").orderBy(F.col("distance").asc(), F.col("y").asc())
    if is_filed(at.rows) and left is right and left_id == right_id and max_d2 is not None:
        past = lambda sent: _stream_both(sent, at, k, max_d2, exclude_self)
    else:
        past = lambda sent: stream_past(sent, at, fn, PAIRS)
    best = lambda df: df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    first = nearest_cells(l, at, k + 1 if exclude_self else k).checkpoint()
    found = best(past(first)).drop("_r").checkpoint()
    # a row with k neighbours looks no further than the last of them
    bound = found.groupBy("x").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    rest = first.withColumnRenamed("cells", "seen").join(bound.select(F.col("x").alias("id"), "bound"), "id", "left")
    rest = cells_within(rest, at, limit).where(F.size("cells") > 0).checkpoint()
    out = found
    if not rest.isEmpty():
        out = best(found.unionByName(past(rest))).drop("_r")
    out = out.withColumn("similarity", similarity_from_distance(F.col("distance")))
    if threshold is not None:
        out = out.where(F.col("similarity") >= F.lit(threshold))   # P13, inclusive
    return out


def nearest_match(batch: DataFrame, store: DataFrame, threshold: float,
                  batch_id: str = "article_id", store_id: str = "article_id",
                  vec: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Per batch row, its nearest stored row if similarity >=
    ``threshold``: ``(x, duplicate_id, similarity)``; rows without a match
    (or without a vector) are absent — join ``left`` to keep them."""
    m = knn_join(batch, store, 1, threshold, batch_id, store_id, vec, block_rows=block_rows)
    return m.select("x", F.col("y").alias("duplicate_id"), "similarity")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str, vec: str = "embedding",
                  block_rows: int | None = None) -> DataFrame:
    """Every pair ``(x, y, distance, similarity)``, x <> y in both directions,
    with similarity >= ``threshold``.  Quadratic in the size of a group of near
    copies: nothing in the library builds on it."""
    rows = vector_rows(vectors, id_col, vec)
    at = lay_out(rows, block_rows)
    if at is None:
        return vectors.sparkSession.createDataFrame([], PAIRS + ", similarity double")
    max_d2 = 2.0 * (1.0 - threshold) if threshold > 0 else None
    sent = cells_within(at.rows.drop("cell") if is_filed(at.rows) else rows, at, distance_limit(threshold))
    part = stream_past(sent, at, _topk_fn(None, max_d2, True), PAIRS)
    return part.withColumn("similarity", similarity_from_distance(F.col("distance"))).where(
        F.col("similarity") >= F.lit(threshold))
