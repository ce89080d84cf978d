"""The order-respecting choice that the reference makes with sequential loops.

All three dedup loops of the reference (D2, D3 seeds, D4 groups) have one
form: *visit nodes in order; a node is chosen iff no earlier chosen node
points to it*.  The result is the lexicographically-first maximal
independent set of a directed graph whose edges go from earlier to later
nodes.  It is computed in parallel rounds:

* a node without an undecided predecessor is CHOSEN, a node with a chosen
  one is OUT (Blelloch, Fineman, Shun, SPAA 2012);
* a node with one undecided predecessor is the opposite of it.  Its own edges
  are handed to that predecessor with the sign turned, so a run of such nodes
  halves every round (pointer doubling): a chain of n takes about log2(n)
  rounds, where the first rule alone takes n / 2.

An edge (src, sign, dst) fires when src turns out as ``sign`` says (chosen or
not); a node is OUT if an edge into it fires, CHOSEN if none can.  An edge of
either sign from the same src is sure to fire.

A round is two joins of the remaining edges with the written states of the
nodes, and two pre-aggregated groupings, checkpointed into the shared
``spark.checkpoint.dir``, so every round's result survives the loss of an
executor.  The driver sees one number per round (the edges left).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)


def _merged(edges: DataFrame) -> DataFrame:
    """One row per (src, dst) of the edges (src, lo, hi, dst): lo <> hi where
    edges of both signs lead from src to dst."""
    return edges.groupBy("src", "dst").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _states(edges: DataFrame) -> DataFrame:
    """Per node with edges into it: ``sure`` (one is sure to fire), and of a node
    with one predecessor that one and the sign (else null)."""
    one = F.count(F.lit(1)) == 1
    return edges.groupBy("dst").agg(
        F.max(F.col("lo") != F.col("hi")).alias("sure"),
        F.when(one, F.min("src")).alias("to"), F.when(one, F.min("lo")).alias("sign")).withColumnRenamed("dst", "node")


def first_in_order_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)``, ``edges(src, dst)`` with src before dst in the visit
    order.  Returns ``(node, chosen boolean)`` for every node."""
    ensure_checkpoint_dir(nodes.sparkSession)
    every = nodes.select("node").distinct()
    live = (edges.select("src", "dst").join(every.select(F.col("node").alias("src")), "src", "left_semi")
            .join(every.select(F.col("node").alias("dst")), "dst", "left_semi"))
    live = _merged(live.withColumn("lo", F.lit(True)).withColumn("hi", F.lit(True))).checkpoint()
    # nodes that were never led to are chosen; the others are decided below
    decided = [every.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("chosen", F.lit(True))]
    known = live.select(F.col("src").alias("node")).distinct().join(live.select(F.col("dst").alias("node")), "node", "left_anti")
    known = known.withColumn("chosen", F.lit(True))
    rounds, remaining = 0, live.count()
    while remaining:
        rounds += 1
        state = _states(live)
        # nothing is handed to a node that is known: its edges end in this round
        open_to = state.where("to is not null").join(known.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to", "sign")
        state = state.select("node", "sure").join(open_to, "node", "left").join(known, "node", "full").checkpoint()
        src = state.select(F.col("node").alias("src"), F.col("chosen").alias("src_chosen"), F.col("sure").alias("src_sure"), "to", "sign")
        dst = state.where("sure").select(F.col("node").alias("dst"))
        met = live.join(dst, "dst", "left_anti").join(src, "src", "left")
        out = F.coalesce("src_chosen", F.when(F.col("src_sure"), F.lit(False)))     # what is known of src
        # into each node: an edge that fires; edges whose src is open, handed on if it has one predecessor
        turned = lambda s: F.when(F.col("to").isNull(), F.col(s)).otherwise(F.col(s) != F.col("sign"))
        met = met.select("dst", F.coalesce("to", "src").alias("src"), out.isNotNull().alias("closed"), (out == F.col("lo")).alias("fires"),
                         turned("lo").alias("lo"), turned("hi").alias("hi")).checkpoint()
        ends = met.groupBy("dst").agg(F.max(F.coalesce("fires", F.lit(False))).alias("fired"), F.min("closed").alias("closed"))
        ends = ends.where("fired or closed").select(F.col("dst").alias("node"), (~F.col("fired")).alias("chosen"))
        fresh = ends.unionByName(state.where("sure and chosen is null").select("node", F.lit(False).alias("chosen"))).checkpoint()
        decided.append(fresh)
        live = _merged(met.where("not closed").select("src", "dst", "lo", "hi")
                       .join(fresh.select(F.col("node").alias("dst")), "dst", "left_anti")).checkpoint()
        known, remaining = fresh, live.count()
        log.info("fixpoint round %d: %d edges left", rounds, remaining)
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.unionByName(more)
    return chosen
