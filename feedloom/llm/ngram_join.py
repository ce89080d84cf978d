r"""Operator 7: Jaccard join on word n-grams, exact, and its components.

A document is the set of its distinct word shingles (64-bit hashes).  Two
documents link when den * |x & y| >= num * |x | y|.  The answer is one row per
document with its component and its number of links; every link is found and
counted, but no list of all pairs of a group is made.

1. Equal sets form a class.
2. Shingles have a fixed total order: those that a sketch over all documents
   finds common come last, the rest by hash.  The order decides how much work
   there is, never the result.  With a(n) = ceil(num n / den), two linked sets
   share a shingle among the first p(n) = n - a(n) + 1 of each, and share k of
   them among the first p(n) - 1 + k.  Shingles of these prefixes that two
   classes have are counted per class; a class with too few is in no link.
3. Each prefix shingle is led by the most central class that has it, and a
   class joins the tiles of the leaders of its shingles: two linked classes
   meet in the tile of the leader of a shingle that they share.
4. Size-banded tiles: a leader's classes are cut into bands of sizes and these
   into tiles of bounded rows and shingles, and tiles meet only if their sizes
   allow a link.  Hashed bitmaps bound the overlap from above:
   |x & y| <= (|x| + |y| - bits(X xor Y)) / 2.  A pair that passes is kept under
   its smallest common leader alone.
5. Classes with such a pair, and no others, bring their arrays to the tile, which decides by
   the exact overlap.  It sends one row per linked class: how many documents it
   links to there, and a class that links lead to.  Sums of the counts are the links, and
   components are completed from the rest.

No step drops pairs that could link, whatever the size of a group.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.  With fewer words than
a shingle has, the whole sequence is the one shingle.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; rows that repeat an id are rows like any other (ids that are
equal fall together in the component's name only); a null id never names a
component unless all ids in it are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import in_bitmap, key_bitmap, slices, stage, text_key, unstage, utf8_list
from feedloom.llm.components import components
from feedloom.llm.hashing import joined, mix, runs, span_hashes

WORDS = 5
SIMILARITY = (80, 100)
#: Bits of a signature per shingle (rounded up to a power of two), rows of a
#: tile, slots of the sketch of common shingles.
BITS = 4
TILE_ROWS = 1024
SKETCH_SLOTS = 1 << 20
#: A slot is common when a task counts this many, and this many times the mean.
COMMON_COUNT, COMMON_TIMES = 32, 8
#: Shingles of a tile.
TILE_SHINGLES = 1 << 20
#: Columns of a block of the membership matrix of a tile.
BLOCK_COLUMNS = 1 << 12
SLICE_BYTES = 2 << 20
#: Sets a task remembers to have sent (beyond it, it may send one again).
SEEN_SETS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    data, begins = joined(texts)
    data = _LOWER[data]
    starts, ends = runs(~_WHITE[data])
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, begins)         # first word of each text
    count = np.diff(first)
    m = max(0, len(h) - words + 1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(words):
        out += h[j:j + m] * _FACTORS[j]
    out = mix(out).view(np.int64)
    sets = []
    for f, c in zip(first.tolist(), count.tolist()):
        if c >= words:
            sets.append(np.unique(out[f:f + c - words + 1]))
        elif c:
            part = (h[f:f + c] * _FACTORS[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)
            sets.append(mix(part).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


class Threshold:
    """Sizes that follow from the similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Smallest size that links with n; overlap that a link needs at least."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1 if n else 0

    def depth(self, n: int) -> int:
        """k of the longer prefix: a quarter more than the short one."""
        return min((self.prefix(n) + 3) // 4, self.least(n))

    def long_prefix(self, n: int) -> int:
        return self.prefix(n) - 1 + self.depth(n) if n else 0

    def shared(self, n: int) -> int:
        """Shared shingles in the longer prefix that a link needs: the depth of
        the smallest partner."""
        return max(1, self.depth(self.least(n)))

    def shared_column(self):
        """``shared`` of the column n."""
        least = lambda n: f"(({n}) * {self.num} + {self.den - 1}) div {self.den}"
        prefix = lambda n: f"(({n}) - {least(n)} + 1)"
        depth = lambda n: f"least(({prefix(n)} + 3) div 4, {least(n)})"
        return F.expr(f"greatest(1, {depth(least('n'))})")

    def links(self, overlap, n, m):
        """Whether an overlap (a number, array or column) is enough."""
        return overlap * self.den >= self.num * (n + m - overlap)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def low64(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def signature(s: np.ndarray, bits: int) -> bytes:
    """Hashed bitmap of a set, as long as the set asks for.  Half of it or-ed
    with the other half is the bitmap of half the length."""
    size = 1 << max(9, (bits * len(s) - 1).bit_length())
    out = np.zeros(size, dtype=bool)
    out[(s.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (size - 1)] = True
    return np.packbits(out).tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (uint64 words) brought to a shorter length."""
    while len(words) > size:
        words = words[:len(words) // 2] | words[len(words) // 2:]
    return words


def _texts(batches, column):
    for whole in batches:
        for b in slices(whole, column, SLICE_BYTES):
            yield b, utf8_list(b.column(column))


def document_sets(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """Per row: doc_id, text_key, n, set_key (and 64 bits of it).  The same
    scan counts every shingle in a sketch; returned is the bitmap of the slots
    that some task finds common, of SKETCH_SLOTS bits at most."""
    schema = "doc_id long, text_key long, n int, set_key binary, key64 long, common array<long>"
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        slots = np.zeros(SKETCH_SLOTS, dtype=np.int64)
        for b, texts in _texts(batches, 2):
            sets = shingle_sets(texts, words)
            slots += np.bincount(np.concatenate(sets) & (SKETCH_SLOTS - 1), minlength=SKETCH_SLOTS)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()),
                 pa.array([low64(k) for k in keys], pa.int64()), pa.nulls(len(keys), types[5])], names=names)
        hot = np.flatnonzero(slots >= max(COMMON_COUNT, COMMON_TIMES * slots.mean()))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:5]), pa.array([hot.tolist()], types[5])], names=names)

    rows = stage(docs.select("doc_id", "text_key", "text").mapInArrow(run, schema), "ngram-sets")
    slots = rows.where("common is not null").select(F.explode("common").alias("slot")).distinct()
    return rows.where("common is null").drop("common"), key_bitmap(slots, "slot", SKETCH_SLOTS)


def prefix_shingles(docs: DataFrame, words: int, t: Threshold, common: np.ndarray) -> DataFrame:
    """(token, cls, short) of the longer prefix of every set; short: the token
    is in the short prefix.  A task sends equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen = set()
        for _, texts in _texts(batches, 0):
            tokens, classes, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for s in shingle_sets(texts, words):
                if not len(s):
                    continue
                key = low64(set_key(s))
                if key in seen:
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(key)
                head = s[np.argsort(in_bitmap(shared.value, s), kind="stable")[:t.long_prefix(len(s))]]
                tokens.append(head)
                classes.append(np.full(len(head), key))
                short.append(np.arange(len(head)) < t.prefix(len(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (tokens, classes, short)], names=["token", "cls", "short"])

    return docs.select("text").mapInArrow(run, "token long, cls long, short boolean")


def held_by_two(rows: DataFrame) -> DataFrame:
    """Rows whose token is held by two or more classes."""
    w = Window.partitionBy("token")
    return (rows.withColumn("lo", F.min("cls").over(w)).withColumn("hi", F.max("cls").over(w))
            .where("lo <> hi").drop("lo", "hi"))


def members(docs: DataFrame, classes: DataFrame, words: int, bits: int | None = None) -> DataFrame:
    """(cls, sig) with ``bits``, else (cls, arr): signature, or sorted array, of
    the given classes (cls), from a scan of the texts through a fixed-size
    bitmap.  A task sends a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(classes, "cls"))

    def run(batches):
        seen = set()
        for _, texts in _texts(batches, 0):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            keys = np.array([low64(set_key(s)) for s in sets], dtype=np.int64)
            out = []
            for i in np.flatnonzero(in_bitmap(shared.value, keys)):
                if keys[i] not in seen:
                    out.append(i)
                    if len(seen) < SEEN_SETS:
                        seen.add(keys[i])
            if bits is not None:
                yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array([signature(sets[i], bits) for i in out], pa.binary())],
                                                 names=["cls", "sig"])
                continue
            ends = np.concatenate([[0], np.cumsum([len(sets[i]) for i in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[out]),
                 pa.ListArray.from_arrays(ends, np.concatenate([sets[i] for i in out]) if out else np.zeros(0, np.int64))],
                names=["cls", "arr"])

    return (docs.select("text").mapInArrow(run, "cls long, arr array<long>" if bits is None else "cls long, sig binary")
            .join(classes.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def led(tiles: DataFrame) -> DataFrame:
    """(lead, cls, n, size): the classes that join the tile of each leader.

    ``tiles``: (cls, n, size, token, shared), shared the number of the class's
    shingles that other classes have; the leader of a token has the most."""
    best = F.min(F.struct((-F.col("shared")).alias("s"), F.col("cls").alias("lead")))
    leads = tiles.groupBy("token").agg(best.alias("l")).select("token", "l.lead")
    return tiles.join(leads, "token").select("lead", "cls", "n", "size").distinct()


def tile_pairs(places: DataFrame, t: Threshold, tile_rows: int, tile_shingles: int) -> DataFrame:
    """Cut the classes of each leader that has more than ``tile_rows`` (or
    ``tile_shingles`` in them) into bands of sizes, and large bands by hash, into
    tiles of about that many; give every row to the tile pairs (i, j) that can
    hold links: adds i, j.  Bands are counted, not sorted, so a leader with very
    many classes is no task of its own.  ``places``: lead, cls, n, size, classes
    and shingles (of the lead)."""
    band = F.col("n") if t.num == t.den else F.floor(F.log("n") / math.log(t.den / t.num))
    band = F.when((F.col("classes") > tile_rows) | (F.col("shingles") > tile_shingles), band).otherwise(0)
    rows = places.withColumn("band", band.cast("long")).drop("classes", "shingles")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / tile_rows), F.least(F.count(F.lit(1)), F.ceil(F.sum("n") / tile_shingles)))
    bands = stage(rows.groupBy("lead", "band").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), parts.alias("parts")), "ngram-bands")
    number = lambda part: F.shiftleft("band", 32) + part
    rows = (rows.join(bands.select("lead", "band", "parts"), ["lead", "band"])
            .withColumn("tile", number(F.pmod(F.xxhash64("cls"), F.col("parts")))).drop("band", "parts"))
    tiles = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("tile", number(F.col("part")))
    a = tiles.select("lead", F.col("tile").alias("i"), F.col("hi").alias("hi_i"))
    b = tiles.select("lead", F.col("tile").alias("j"), F.col("lo").alias("lo_j"))
    met = a.join(b, "lead").where((F.col("i") <= F.col("j")) & (F.col("hi_i") * t.den >= F.col("lo_j") * t.num))
    sides = met.select("lead", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile")).select(
        "lead", "i", "j", "tile")
    return rows.join(sides, ["lead", "tile"])


def _runs_of(batches):
    """Batches cut into runs of equal (lead, i, j), whole across batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = [t[c].to_numpy() for c in ("lead", "i", "j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield t.slice(0, last).combine_chunks(), np.concatenate([[0], cut])
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|sets[x] & sets[y]| of each pair (x, y), exact; y is in order."""
    rows, sizes = len(sets), np.array([len(s) for s in sets])
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = held > 1                      # what one set alone has is in no overlap
    number = np.cumsum(several) - 1
    width = int(several.sum())
    row, use = np.repeat(np.arange(rows), sizes), several[col]
    row, col = row[use], number[col[use]]
    begins = np.searchsorted(row, np.arange(rows + 1))
    sizes = np.diff(begins)
    if 30 * sizes[x].sum() > rows * rows * width:
        # many pairs of like sets: products of the membership matrix
        order = np.argsort(col, kind="stable")
        at, among = np.searchsorted(col[order], np.arange(0, width + BLOCK_COLUMNS, BLOCK_COLUMNS)), np.zeros((rows, rows))
        for k, (lo, hi) in enumerate(zip(at, at[1:])):
            block = np.zeros((rows, min(BLOCK_COLUMNS, width - k * BLOCK_COLUMNS)), dtype=np.float32)
            block[row[order[lo:hi]], col[order[lo:hi]] - k * BLOCK_COLUMNS] = 1
            among += block @ block.T
        return among[x, y].astype(np.int64)
    out, marked = np.zeros(len(x), dtype=np.int64), np.zeros(width, dtype=bool)
    cuts = np.flatnonzero(np.diff(y, prepend=-1, append=-1))
    for lo, hi in zip(cuts, cuts[1:]):
        mine = col[begins[y[lo]]:begins[y[lo] + 1]]
        marked[mine] = True
        for k in range(lo, hi):
            out[k] = np.count_nonzero(marked[col[begins[x[k]]:begins[x[k] + 1]]])
        marked[mine] = False
    return out


def roots(rows: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest row that pairs (x, y) lead to, of each row."""
    label = np.arange(rows)
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_tiles(rows: DataFrame, t: Threshold) -> DataFrame:
    """Compare the classes of each tile pair.  A pair counts under its smallest
    common leader alone.  ``rows``: lead, i, j, tile, n, cls, size, sig, leads
    (the leaders whose tiles the class is in), and perhaps arr.

    Without arr: the rows (lead, i, j, tile, n, cls, size) that have a pair
    which passes the bound.  With arr: (a, b, links), for a class a that has
    links in the tile, documents it links to there and a class b (perhaps a)
    that links lead to."""
    keys, exact = ["lead", "i", "j", "tile", "n", "cls", "size"], "arr" in rows.columns

    def candidates(n, tile, maps, same):
        """Pairs that pass the bound, in order of y."""
        sizes, out = np.array([len(v) for v in maps]), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        by_size = {z: (at := np.flatnonzero(sizes == z), np.vstack([maps[k] for k in at])) for z in set(sizes.tolist())}
        first = np.searchsorted(n * t.den, n * t.num)       # rows are in order of size
        for y in range(1, len(n)):
            for z, (at, matrix) in by_size.items():
                # a smaller set never has the longer bitmap
                k = np.arange(*np.searchsorted(at, (first[y], y))) if z <= sizes[y] else np.arange(0)
                k = k if same else k[tile[at[k]] != tile[y]]
                if not len(k):
                    continue
                differ = np.bitwise_count(matrix[k] ^ folded(maps[y], z)).sum(axis=1, dtype=np.int64)
                x = at[k]
                x = x[t.links((n[x] + n[y] - differ) // 2, n[x], n[y])]
                out.append((x, np.full(len(x), y)))
        return tuple(map(np.concatenate, zip(*out)))

    def run(batches):
        for table, cuts in _runs_of(batches):
            col = {c: table[c].to_numpy() for c in keys}
            sig, leads = table["sig"].chunk(0), table["leads"].chunk(0)
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                n, tile, cls, size = (col[c][lo:hi] for c in ("n", "tile", "cls", "size"))
                n = n.astype(np.int64)
                maps = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in sig.slice(lo, hi - lo)]
                x, y = candidates(n, tile, maps, col["i"][lo] == col["j"][lo])
                if len(x):
                    before = [(v := leads[k].values.to_numpy())[v < col["lead"][lo]] for k in range(lo, hi)]
                    first = overlaps(before, x, y) == 0
                    x, y = x[first], y[first]
                if not exact:
                    near = np.unique(np.concatenate([x, y]))
                    if len(near):
                        yield table.select(keys).take(pa.array(lo + near)).combine_chunks().to_batches()[0]
                    continue
                if len(x):
                    arr = table["arr"].chunk(0)
                    both = overlaps([arr[k].values.to_numpy() for k in range(lo, hi)], x, y)
                    linked = t.links(both, n[x], n[y])
                    x, y = x[linked], y[linked]
                if len(x):
                    count = np.zeros(hi - lo, dtype=np.int64)
                    np.add.at(count, x, size[y])
                    np.add.at(count, y, size[x])
                    has = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls[has]), pa.array(cls[roots(hi - lo, x, y)[has]]), pa.array(count[has])],
                        names=["a", "b", "links"])

    columns = [*keys, "sig", "leads"] + (["arr"] if exact else [])
    schema = "a long, b long, links long" if exact else rows.select(*keys).schema
    return (rows.select(*columns).repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "n", "cls")
            .mapInArrow(run, schema))


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", bits: int = BITS, tile_rows: int = TILE_ROWS,
               tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id (smallest doc_id
    that links lead to, its own included), n_links (other rows that it links
    with, those with an equal set included), component (a number of the
    component that null ids have too; null for an empty set)."""
    t = Threshold(*similarity)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    sets, common = document_sets(docs, words)
    groups = stage(sets.where("n > 0").groupBy("set_key").agg(
        F.min("key64").alias("cls"), F.min("n").alias("n"), F.min("doc_id").alias("least_id"),
        F.count(F.lit(1)).alias("size")), "ngram-classes")
    if not groups.groupBy("cls").count().where("count > 1").isEmpty():
        raise RuntimeError("two different sets agree in the 64 bits that name classes")
    shared = stage(held_by_two(prefix_shingles(docs, words, t, common)).distinct(), "ngram-shared")

    # classes with enough shared shingles; the short prefixes of those
    candidates = (shared.groupBy("cls").agg(F.count(F.lit(1)).alias("shared"))
                  .join(groups.select("cls", "n", "size"), "cls").where(F.col("shared") >= t.shared_column()))
    tiles = stage(held_by_two(shared.where("short").drop("short").join(candidates, "cls")), "ngram-tiles")
    unstage(shared)
    places = stage(led(tiles), "ngram-places")
    unstage(tiles)
    maps = stage(members(docs, places.select("cls").distinct(), words, bits), "ngram-maps")
    of_lead = places.groupBy("lead").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles")).where("classes > 1")
    placed = stage(places.join(of_lead, "lead"), "ngram-open")
    unstage(places)
    leads = placed.groupBy("cls").agg(F.sort_array(F.collect_list("lead")).alias("leads"))
    leads = stage(leads, "ngram-leads")
    rows = tile_pairs(placed, t, tile_rows, tile_shingles).join(maps, "cls").join(leads, "cls")
    near = stage(compare_tiles(rows, t), "ngram-near")
    # an array is made, and goes, only where a class has a pair that may link
    arrays = stage(members(docs, near.select("cls").distinct(), words), "ngram-members")
    found = stage(compare_tiles(near.join(maps, "cls").join(arrays, "cls").join(leads, "cls"), t), "ngram-links")
    unstage(placed, near, maps, arrays, leads)
    final = components(found.select("a", "b")).withColumnRenamed("node", "cls")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))

    named = groups.join(final, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    keys = (named.join(names, "component").join(counts, "cls", "left")
            .where("size > 1 or links > 0 or component_id <> least_id or least_id is null")
            .select("set_key", "component_id", "component", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # written first: a join of two plain tables is one that Spark splits where a class is large
    return (sets.join(stage(keys, "ngram-named"), "set_key", "left")
            .select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("n") > 0, F.coalesce("component", "key64")).alias("component")))
