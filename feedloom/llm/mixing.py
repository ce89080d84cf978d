"""Operator 1: mix sources to target weights by Pfair scheduling.

The documents of a source, in a fixed shuffled order, are cut into blocks of
``block_rows``.  With target weight w, block i of a source (from 1) is released
at slot floor((i - 1) / w) and due by slot ceil(i / w).  Every slot takes, of
the released blocks, the one due first.  With weights that sum to 1 no block
misses its deadline and none starts before its release, so after any number of
slots each source has got its share to within less than one block.

Weights are exact fractions, brought to a common denominator: the cycle, in
which every source gets exactly its whole shares.  The schedule repeats with
it, so one cycle is computed and any block's slot follows from it by
arithmetic: the blocks of a large source need no simulation.  A cycle longer
than its epoch is computed as far as the epoch goes, so weights without a
short common denominator cost the driver a step per block.  When a source has
no blocks left, its weight goes to the others in proportion and a new epoch starts; no
document is dropped.  There are at most as many epochs as sources.

What reaches the driver is one count per target (sources without a target are
pooled), so its size is set by the caller's targets, not by the data.  Ranks
within a source come from a fixed number of hash ranges: rows are numbered
within their range and ranges are counted before, so a source with a third of
all rows is spread over all tasks.

Defined cases: a null or unlisted source belongs to the pool ``None``; a
target of 0 comes after all others; null ids, texts and repeated rows are
rows like any other; an empty table gives an empty mix; other columns are not
read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
#: A weight is the fraction of at most this denominator that it is a float of
#: (to its last bits), else the exact value of the float.
DENOMINATOR, LAST_BITS = 10 ** 6, Fraction(1, 1 << 50)
#: Hash ranges that a source is numbered in.
RANGES = 1024


@dataclass(frozen=True)
class Share:
    """A source in an epoch: its first block, number of blocks, shares of the
    cycle, length of the cycle, and the slot in it of each of its shares, with
    the window that the slot is in."""
    source: str | None
    epoch: int
    start_slot: int
    first_block: int
    blocks: int
    shares: int
    cycle: int
    slots: list[int]
    releases: list[int]
    deadlines: list[int]


def exact_shares(weights: dict) -> dict:
    """Whole shares in exactly the proportions of the weights."""
    def fraction(w):
        near = Fraction(w).limit_denominator(DENOMINATOR)
        return near if abs(near - Fraction(w)) <= LAST_BITS * Fraction(w) else Fraction(w)

    exact = {s: fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * whole) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def cycle_slots(shares: dict, left: dict | None = None) -> dict:
    """Earliest deadline first over one cycle: the slots each source gets.
    With ``left``, it ends with the first source that has had so many."""
    cycle = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    waiting = [(0, n, 1) for n in range(len(names))]        # release, source, block
    ready: list[tuple[int, int, int]] = []                  # deadline, source, block
    out = {s: [] for s in names}
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            _, n, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * cycle // shares[names[n]]), n, i))
        deadline, n, i = heapq.heappop(ready)
        out[names[n]].append(t)
        if left and i == left[names[n]]:
            break
        if i < shares[names[n]]:
            heapq.heappush(waiting, (i * cycle // shares[names[n]], n, i + 1))
    return out


def plan(blocks: dict, targets: dict) -> list[Share]:
    """The epochs of a mix of sources with so many blocks each."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, slot, epoch = [], 0, 0
    while left:
        weights = {s: targets.get(s, 0) for s in left}
        weights = {s: w for s, w in weights.items() if w > 0} or dict.fromkeys(left, 1)
        shares = exact_shares(weights)
        slots, size = cycle_slots(shares, {s: left[s] for s in weights}), sum(shares.values())
        releases = {s: [i * size // shares[s] for i in range(len(x))] for s, x in slots.items()}
        deadlines = {s: [-(-i * size // shares[s]) for i in range(1, len(x) + 1)] for s, x in slots.items()}
        if (end := sum(map(len, slots.values()))) < size:   # the epoch is shorter than the cycle
            shares, size = {s: len(x) for s, x in slots.items()}, end
        else:
            # the epoch ends behind the last block of the source that runs out first
            end = min((left[s] - 1) // shares[s] * size + slots[s][(left[s] - 1) % shares[s]] for s in weights) + 1
        for s in weights:
            n = end // size * shares[s] + sum(x < end % size for x in slots[s])
            if n:
                out.append(Share(s, epoch, slot, done[s], n, shares[s], size, slots[s], releases[s], deadlines[s]))
                done[s] += n
                left[s] -= n
                if not left[s]:
                    del left[s]
        slot, epoch = slot + end, epoch + 1
    return out


def mix(docs: DataFrame, targets: dict, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS,
        pool_target: float = 0.0, tie: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, pool, block (within its pool, from 0), epoch, slot,
    release, deadline and position (order of the mix; unique).

    ``targets`` maps sources to weights, ``pool_target`` is the weight of all
    other sources together.  Rows with one id are in the order of ``tie``, if
    given, which must tell them apart.  ``extra`` names columns to carry along."""
    spark = docs.sparkSession
    extra = extra or {}
    source = F.col(source_col).cast("string")
    order = F.xxhash64(F.col(id_col).cast("long"), F.lit(17))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.when(source.isin(*targets), source).alias("pool"),
        order.alias("o"), (F.lit(0) if tie is None else tie).alias("t"), *(c.alias(k) for k, c in extra.items()))
    rows = rows.withColumn("range", F.pmod(F.shiftright("o", 32), F.lit(RANGES)).cast("int"))

    counts = rows.groupBy("pool", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pool").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pool", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r.pool: r.n for r in counts.groupBy("pool").agg(F.sum("n").alias("n")).collect()}
    weights = dict(targets) | {None: pool_target}
    shares = plan({s: -(-n // block_rows) for s, n in totals.items()}, weights)
    table = spark.createDataFrame(
        [(s.source, s.epoch, s.start_slot, s.first_block, s.blocks, s.shares, s.cycle, s.slots, s.releases, s.deadlines)
         for s in shares],
        "pool string, epoch int, start_slot long, first_block long, blocks long, shares long, size long, "
        "slots array<long>, releases array<long>, deadlines array<long>")

    within = Window.partitionBy("pool", "range").orderBy("o", "doc_id", "t")
    ranked = rows.withColumn("i", F.row_number().over(within)).alias("r")
    # both tables are bounded by the number of targets: targets x RANGES, targets x targets
    o, t = F.broadcast(offsets).alias("f"), F.broadcast(table).alias("t")
    ranked = (ranked.join(o, F.col("r.pool").eqNullSafe(F.col("f.pool")) & (F.col("r.range") == F.col("f.range")))
              .select("r.*", (F.col("f.before") + F.col("r.i") - 1).alias("rank"))
              .withColumn("block", F.expr(f"rank div {block_rows}")).alias("r"))
    here = F.col("block") - F.col("first_block")
    mixed = ranked.join(t, F.col("r.pool").eqNullSafe(F.col("t.pool")) & (here >= 0) & (here < F.col("blocks")))
    lap, nth = F.expr("(block - first_block) div shares"), F.expr("(block - first_block) % shares")
    at = lambda c: F.col("start_slot") + lap * F.col("size") + F.element_at(c, (nth + 1).cast("int"))
    slot = at("slots")
    return mixed.select(
        "doc_id", F.col("r.pool").alias("pool"), "block", "epoch", slot.alias("slot"), at("releases").alias("release"),
        at("deadlines").alias("deadline"), (slot * block_rows + F.col("rank") % block_rows).alias("position"), *extra)
