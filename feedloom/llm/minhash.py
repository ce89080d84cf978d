r"""Operator 11: near duplicates by circulant MinHash, banding and exact Jaccard.

A document is the set of its distinct word shingles.  Two documents link when
den * |x & y| >= num * |x | y|; the answer is one row per document with the
smallest id of its component.

Signature.  Two permutations serve all coordinates: sigma, applied once, and
pi, shifted circularly by k places for coordinate k:
``h_k(S) = min over x in S of pi[(sigma[x] + k) mod D]``.  The values that one
shingle adds to all coordinates are one run of pi, so a signature is the
minimum of as many runs as the set has shingles.  (Shingle hashes are folded
onto D positions; where that makes two sets look more alike than they are, a
candidate more is compared.)

1. One scan writes every document's set key, size, signature and band keys;
   equal sets form a class (a task that has met a set does not sign it again).
2. Classes that share a band key meet under the key's leader, its most central
   class (whose keys are shared the most): places (leader, class), few per class
   however large the group.
3. First round: each class is compared, on full sets, with the leader that it
   shares the most bands with.  The linked pairs give provisional components.
4. Second round: only leaders whose classes are in several provisional
   components are left.  Their classes are cut into tiles by size and hash; the
   classes outside the leader's largest component stream past the tiles (a link
   between two components has such a class), and pairs of different components
   that agree in enough coordinates have their full sets compared in a second
   pass.  So a group of near copies costs rows, not pairs.

Every link is confirmed on full sets.  A link is missed only if no band agrees
or too few coordinates do; rows of a band and the least agreement follow from
the similarity such that this is rarer than ``MISS`` for a pair that just links
(at 0.85: 6 in 10^11 for the bands).

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; with fewer words than a
shingle has, the whole sequence is the one shingle.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; rows that repeat an id are rows like any other; a null id never
names a component unless all its ids are null, and is then kept as null; other
columns are not read; a similarity of 1 leaves the classes as they are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import in_bitmap, key_bitmap, slices, stage, text_key, unstage, utf8_list
from feedloom.llm.components import components
from feedloom.llm.hashing import mix
from feedloom.llm.ngram_join import Threshold, low64, set_key, shingle_sets

WORDS = 5
SIMILARITY = (85, 100)
#: Coordinates of a signature, positions of the permutations.
COORDINATES, POSITIONS = 128, 1 << 20
#: Chance that a pair which just links is no candidate.
MISS = 1e-7
#: Rows and shingles of a tile, rows that meet one copy of a leader's set.
TILE_ROWS, TILE_SHINGLES, PART_ROWS = 1024, 1 << 20, 256
#: Shingles whose runs are reduced at once; bytes of text taken at once.
RUN_ROWS, SLICE_BYTES = 2048, 2 << 20
#: Sets a task remembers to have signed or sent (beyond it, it may do so again).
SEEN_SETS = 1 << 20

_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def permutations(positions: int = POSITIONS, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi as overlapping runs: row p holds pi[p], pi[p + 1], ..."""
    rng = np.random.Generator(np.random.PCG64(20240511))
    sigma, pi = (rng.permutation(positions).astype(np.uint32) for _ in range(2))
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates - 1]]), coordinates)


def signature(s: np.ndarray) -> np.ndarray:
    """All coordinates of the signature of a set of shingle hashes."""
    sigma, runs = permutations()
    at = sigma[s & (len(sigma) - 1)]
    out = runs[at[:RUN_ROWS]].min(axis=0)
    for k in range(RUN_ROWS, len(at), RUN_ROWS):
        np.minimum(out, runs[at[k:k + RUN_ROWS]].min(axis=0), out=out)
    return out


def band_count(similarity: float) -> int:
    """Fewest bands of 8, 4, 2 or 1 rows that miss a pair of this similarity
    less often than MISS."""
    for r in (8, 4, 2):
        if (1 - similarity ** r) ** (COORDINATES // r) <= MISS:
            return COORDINATES // r
    return COORDINATES


def least_agreement(similarity: float) -> int:
    """Coordinates that two sets of this similarity agree in but for a chance of
    MISS / 1000."""
    below, a = 0.0, 0
    while a < COORDINATES:
        below += math.comb(COORDINATES, a) * similarity ** a * (1 - similarity) ** (COORDINATES - a)
        if below > MISS / 1000:
            break
        a += 1
    return a


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One key (int64) per row and band, the band's number mixed in."""
    parts = (signatures * _FACTORS).reshape(len(signatures), bands, -1).sum(axis=2, dtype=np.uint64)
    return mix(parts + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _sets(batches, column, words):
    for whole in batches:
        for b in slices(whole, column, SLICE_BYTES):
            yield b, shingle_sets(utf8_list(b.column(column)), words)


def signed(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """Per row: doc_id, text_key, n, set_key, key64 (of set_key), and of a set
    that the task has not met before its band keys and the low bytes of its
    signature."""
    schema = "doc_id long, text_key long, n int, set_key binary, key64 long, bands array<long>, sig binary"

    def run(batches):
        seen = set()
        for b, sets in _sets(batches, 2, words):
            keys = [set_key(s) for s in sets]
            new = []
            for i, (k, s) in enumerate(zip(keys, sets)):
                if len(s) and k not in seen:
                    new.append(i)
                    if len(seen) < SEEN_SETS:
                        seen.add(k)
            sigs = np.stack([signature(sets[i]) for i in new]) if new else np.zeros((0, COORDINATES), np.uint32)
            band, low = [None] * len(sets), [None] * len(sets)
            for i, keys_of, sig in zip(new, band_keys(sigs, bands), sigs.astype(np.uint8)):
                band[i], low[i] = keys_of, sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()),
                 pa.array([low64(k) for k in keys], pa.int64()), pa.array(band, pa.list_(pa.int64())),
                 pa.array(low, pa.binary())], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, arr): the sorted set of each wanted class (cls, set_key, key64),
    from a scan of the texts through a bitmap.  A task sends a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, "key64"))

    def run(batches):
        seen = set()
        for _, sets in _sets(batches, 0, words):
            keys = [set_key(s) for s in sets]
            among = in_bitmap(shared.value, np.array([low64(k) for k in keys], dtype=np.int64))
            out = []
            for i in np.flatnonzero(among):
                if len(sets[i]) and keys[i] not in seen:
                    out.append(i)
                    if len(seen) < SEEN_SETS:
                        seen.add(keys[i])
            ends = np.cumsum([0, *(len(sets[i]) for i in out)]).astype(np.int32)
            flat = np.concatenate([sets[i] for i in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in out], pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                                             names=["set_key", "arr"])

    return (docs.select("text").mapInArrow(run, "set_key binary, arr array<long>").dropDuplicates(["set_key"])
            .join(wanted.select("cls", "set_key"), "set_key").select("cls", "arr"))


def places(classes: DataFrame) -> DataFrame:
    """(lead, cls, shared): each class under the leader of every band key that
    it shares with another class; shared: how many keys lead there.  The leader
    has the most places in its keys: the text that others are copies of, not one
    copy of many, so that fewer are left unlinked by the first round."""
    keys = classes.select("cls", F.explode("bands").alias("bucket"))
    held = keys.groupBy("bucket").agg(F.min("cls").alias("first"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("held"))
    # a class has one row per band
    met = F.sum("held").over(Window.partitionBy("cls"))
    rows = keys.join(held.where("first <> last").select("bucket", "held"), "bucket")
    rows = stage(rows.select("cls", "bucket", met.alias("met")), "minhash-shared")
    best = F.min(F.struct((-F.col("met")).alias("m"), F.col("cls").alias("lead")))
    leads = stage(rows.groupBy("bucket").agg(best.alias("l")).select("bucket", "l.lead"), "minhash-leads")
    out = stage(rows.join(leads, "bucket").groupBy("lead", "cls").agg(F.count(F.lit(1)).alias("shared")), "minhash-places")
    unstage(rows, leads)
    return out


def _runs(batches, keys):
    """(first of the run, key, batch) of stretches of equal keys, in order; a run
    may go on in the next batch."""
    last = None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else np.zeros(0, int)
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            if hi > lo:
                key = tuple(int(c[lo]) for c in cols)
                yield key != last, key, b.slice(lo, hi - lo)
                last = key


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """|a & b| of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def star_links(star: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) of the pairs of ``star`` (cls, lead) that link on full sets.  A
    leader's set is copied once for every PART_ROWS of its classes, which stream
    past it."""
    count = star.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    count = stage(count, "minhash-parts")
    side = lambda n: F.lit(n).cast("int").alias("side")
    theirs = star.join(count, "lead").select("lead", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"), "cls", side(1))
    own = count.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("cls"), side(0))
    rows = own.unionByName(theirs).join(sets, "cls")

    def run(batches):
        lead = None
        for new, key, b in _runs(batches, ("lead", "part")):
            cls, arr = b.column(2).to_numpy(), b.column(4)
            first = 0
            if new:
                lead, first = arr[0].values.to_numpy(), 1
            hits = [i for i in range(first, b.num_rows)
                    if t.links(_common(lead, m := arr[i].values.to_numpy()), len(lead), len(m))]
            yield pa.RecordBatch.from_arrays([pa.array(cls[hits]), pa.array(np.full(len(hits), key[0], dtype=np.int64))], names=["a", "b"])

    return (rows.select("lead", "part", "cls", "side", "arr").repartition("lead", "part")
            .sortWithinPartitions("lead", "part", "side", "cls").mapInArrow(run, "a long, b long"))


def open_tiles(placed: DataFrame, t: Threshold, tile_rows: int) -> DataFrame:
    """(lead, band, part, side, cls, n, comp, sig): the classes of the leaders
    that have several components (``placed``: lead, cls, n, comp, sig), each in
    one tile (side 0), and those outside the leader's largest component once more
    in every tile of sizes that could link (side 1)."""
    per = placed.groupBy("lead", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = per.groupBy("lead").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    several = stage(several.where("comps > 1").select("lead", F.col("m.comp").alias("main")), "minhash-open")
    # linked sets are at most one band apart; the bands are a little wider than that asks for
    band = F.floor(F.log("n") / (1.001 * math.log(t.den / t.num))).cast("long")
    rows = stage(placed.join(several, "lead").withColumn("band", band), "minhash-rows")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / tile_rows), F.ceil(F.sum("n") / TILE_SHINGLES))
    cells = stage(rows.groupBy("lead", "band").agg(parts.alias("parts")), "minhash-cells")
    side = lambda n: F.lit(n).cast("int").alias("side")
    out = ("cls", "n", "comp", "sig")
    held = rows.join(cells, ["lead", "band"]).select(
        "lead", "band", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"), side(0), *out)
    near = rows.where("comp <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    past = near.join(cells, ["lead", "band"]).select(
        "lead", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), side(1), *out)
    return held.unionByName(past)


def compare_tiles(rows: DataFrame, t: Threshold, agree: int) -> DataFrame:
    """Compare the rows of side 1 with the tile (side 0) that they stream past,
    as far as their components differ.  ``rows``: as of ``open_tiles``, perhaps
    with arr.  Without arr: the rows that have a pair which agrees in
    enough coordinates.  With arr: (a, b), components joined by a link; two
    that a tile has joined already are not compared again there."""
    keys, exact = ["lead", "band", "part", "side", "cls", "n", "comp", "sig"], "arr" in rows.columns

    def run(batches):
        tile, near = [], []

        def flush():
            """The rows of the tile that had a pair."""
            if not exact and tile and any(m.any() for m in near):
                yield pa.Table.from_batches([b.filter(pa.array(m)) for b, m in zip(tile, near)]).combine_chunks().to_batches()[0]

        held = at = None
        for _, key, b in _runs(batches, ("lead", "band", "part", "side")):
            side = key[3]
            if key[:3] != at:
                yield from flush()
                tile, near, held, sets, joined, at = [], [], None, [], {}, key[:3]
            if side == 1 and held is None:          # a tile that no row fell into
                continue
            if side == 0:
                tile.append(b.select(keys))
                near.append(np.zeros(b.num_rows, dtype=bool))
            n, comp = b.column(5).to_numpy().astype(np.int64), b.column(6).to_numpy()
            sig = np.frombuffer(b"".join(b.column(7).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            arr = [b.column(8)[i].values.to_numpy() for i in range(b.num_rows)] if exact else []
            if side == 0:
                held = [np.concatenate(z) for z in zip(held, (n, comp, sig))] if held else [n, comp, sig]
                sets = sets + arr
                continue
            n0, comp0, sig0 = held
            mine, mark = [], np.concatenate(near)
            for i in range(b.num_rows):
                low, high = np.minimum(n0, n[i]), np.maximum(n0, n[i])
                fit = np.flatnonzero((comp0 != comp[i]) & (low * t.den >= high * t.num))
                fit = fit[(sig0[fit] == sig[i]).sum(axis=1) >= agree]
                if not exact:
                    mark[fit] = True
                    if len(fit):
                        mine.append(i)
                    continue
                for k in fit:
                    x, y = _root(joined, int(comp0[k])), _root(joined, int(comp[i]))
                    if x != y and t.links(_common(sets[k], arr[i]), len(sets[k]), len(arr[i])):
                        joined[max(x, y)] = min(x, y)
                        mine.append((x, y))
            if exact:
                pairs = np.array(mine, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            else:
                near = np.split(mark, np.cumsum([len(m) for m in near])[:-1])
                yield b.select(keys).take(pa.array(mine, pa.int64()))
        yield from flush()

    columns = keys + (["arr"] if exact else [])
    schema = "a long, b long" if exact else rows.select(*keys).schema
    return (rows.select(*columns).repartition("lead", "band", "part").sortWithinPartitions("lead", "band", "part", "side", "cls")
            .mapInArrow(run, schema))


def _root(up: dict[int, int], x: int) -> int:
    while x in up:
        x = up[x]
    return x


def joined_classes(docs: DataFrame, classes: DataFrame, words: int, t: Threshold, tile_rows: int) -> DataFrame:
    """(set_key, least_id, component) of every class, from the links of both
    rounds."""
    placed = places(classes)
    star = (placed.where("lead <> cls").groupBy("cls").agg(F.max(F.struct("shared", "lead")).alias("m"))
            .select("cls", F.col("m.lead").alias("lead")))
    star = stage(star, "minhash-star")
    wanted = classes.select("cls", "set_key", "key64").join(placed.select("cls").distinct(), "cls", "left_semi")
    full = stage(arrays(docs, stage(wanted, "minhash-wanted"), words), "minhash-arrays")
    first = stage(components(star_links(star, full, t)).withColumnRenamed("node", "cls"), "minhash-first")
    unstage(star)

    comp = F.coalesce("component", "cls").alias("comp")
    # what a place needs is joined before it is copied to tiles
    named = placed.select("lead", "cls").join(classes.select("cls", "n", "sig"), "cls").join(first, "cls", "left")
    named = stage(named.select("lead", "cls", "n", comp, "sig"), "minhash-named")
    unstage(placed)
    agree = least_agreement(t.num / t.den)
    near = stage(compare_tiles(open_tiles(named, t, tile_rows), t, agree), "minhash-near")
    unstage(named)
    # full sets go only where a class has a pair that may link
    second = compare_tiles(near.join(full, "cls"), t, agree)
    last = components(second).select(F.col("node").alias("comp"), F.col("component").alias("merged"))
    unstage(near, full)
    return (classes.select("cls", "set_key", "least_id").join(first, "cls", "left")
            .select("set_key", "least_id", comp).join(last, "comp", "left")
            .select("set_key", "least_id", F.coalesce("merged", "comp").alias("component")))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id (smallest doc_id
    that links lead to, its own included), kept (doc_id = component_id),
    component (a number of the component that null ids have too; null for an
    empty set)."""
    t = Threshold(*similarity)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    sets = stage(signed(docs, words, band_count(t.num / t.den)), "minhash-sets")
    one = lambda c: F.any_value(c, True).alias(c)
    groups = sets.where("n > 0").groupBy("set_key").agg(
        one("key64"), one("n"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"), one("bands"), one("sig"))
    # numbered as they are written: unique, and fixed from then on
    classes = stage(groups.withColumn("cls", F.monotonically_increasing_id()), "minhash-classes")

    final = classes.select("set_key", "least_id", F.col("cls").alias("component"))
    if t.num < t.den:
        final = stage(joined_classes(docs, classes, words, t, tile_rows), "minhash-final")
        unstage(classes)
    names = stage(final.groupBy("component").agg(F.min("least_id").alias("component_id")), "minhash-names")
    keys = stage(final.join(names, "component").select("set_key", "component", "component_id"), "minhash-keys")
    # a join of two plain tables is one that Spark splits where a class is large
    return (sets.select("doc_id", "text_key", "n", "set_key").join(keys, "set_key", "left")
            .select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"), "component"))
