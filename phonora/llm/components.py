"""Distributed union-find: connected components of an edge table.

Each round contracts edges inside every task with a local union-find and then applies one
large-star and one small-star step (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).  Edges never leave the cluster; only counts and a checksum reach the driver.  A task
contracts a bounded number of edges, so few edges take few tasks and fewer rounds; what one local
union-find holds takes one task and no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.llm.common import durable

#: Edges that one local union-find holds at a time, and edges that make a task of a round.
CHUNK, SHARE = 500_000, 100_000
#: Neighbours from which a node is a hub, and hubs whose smallest neighbours are broadcast; beyond, they are shuffled.
HUB, BROADCAST_HUBS = 64, 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low = np.minimum(ra, rb)
        np.minimum.at(root, np.maximum(ra, rb), low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest (node, smallest node of its tree) of the edges (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(index[: len(a)], index[len(a) :], len(nodes))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_a, held_b, held = [], [], 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= CHUNK:
            yield out()
            held_a, held_b, held = [], [], 0
    if held:
        yield out()


def _signature(edges: DataFrame) -> tuple:
    """(edges, checksum, most edges of one root)."""
    roots = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    row = roots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return row["n"], row["s"], row["most"]


def _with_lowest(both: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The rows of ``both`` with b > a, and with the smallest of ``a`` and its neighbours as low.

    The rows of ``hubs``, whose number has been checked, stay where they are and get their minima by broadcast.
    """
    lowest = lambda rows: rows.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
    above, same = both.filter("b > a"), F.col("a") == F.col("at")
    if hubs is None:
        return above.join(lowest(both), same)
    hubs = F.broadcast(hubs)
    of_hubs = F.broadcast(lowest(both.join(hubs, F.col("a") == F.col("hub"), "left_semi")))
    rest = both.join(hubs, F.col("a") == F.col("hub"), "left_anti")
    return rest.filter("b > a").join(lowest(rest), same).unionByName(above.join(of_hubs, same))


def _stars(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """One large-star and one small-star step over edges with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_lowest(both, hubs).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    # A node has one root for each task that contracted its edges, so no window is large.
    small = large.withColumn("low", F.min("b").over(W.partitionBy("a")))
    ends = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
    return small.select(ends.alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60, hub: int = HUB, whole: int = CHUNK) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: root is the smallest node reachable.

    Self-loops and repeated edges have no effect; an empty table gives an empty result.  Up to ``whole`` edges,
    ``CHUNK`` at most, are contracted by one task, which settles them: rounds would put far more on the driver
    than on that task.
    """
    if whole > CHUNK:
        raise ValueError(f"a task contracts {CHUNK} edges at most")
    contracted = lambda df: durable(df.mapInArrow(_contract, "a long, b long"))
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = contracted(edges.distinct())
    settled = lambda: edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    n = edges.count()
    if n <= whole:
        edges = contracted(edges.coalesce(1)) if n else edges
        return settled()
    before = _signature(edges)
    for _ in range(max_rounds):
        hubs = None
        if before[2] > hub:
            hubs = durable(edges.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("hub"))
            hubs = hubs if hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else None
        edges = contracted(_stars(edges, hubs).coalesce(before[0] // SHARE + 1))
        after = _signature(edges)
        if after == before:
            break
        if after[0] <= whole:
            edges = contracted(edges.coalesce(1))
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return settled()
