"""Connected components of a link table: forests within partitions, then alternating large and small stars.

Links are kept in partitions of about ``ROWS`` links. Each partition's links are contracted to a forest of
stars by one task, whose memory ``ROWS`` bounds; a graph that fits one partition is done with that. Otherwise
rounds of stars follow: grouped minima with a join back, on rows of two ids, each contracted again. No group
is collected, a hub's links are pre-aggregated before each shuffle and salted where they are joined, and
each round is cut through the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut

#: Links that a partition holds on the average.
ROWS = 250_000
#: Parts into which a node's links are dealt when they meet the node's minimum, so that a hub is no single task's.
SALTS = 16


def contracted(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each node's least connected node, of nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        live = a != b
        if not live.any():
            return label
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: each node with its component's least."""
    held = list(batches)
    if held:
        u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
        ids, number = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = contracted(len(ids), number[: len(u)], number[len(u) :])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], names=["u", "v"])


def _contract(edges: DataFrame, about: int) -> DataFrame:
    return cut(edges.coalesce(max(1, -(-about // ROWS))).mapInArrow(_forest, "u long, v long"))


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link with its node's minimum ``m``; a hub's links are dealt over ``SALTS`` keys."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every.hint("merge"), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, about: int) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long) that is not its component's least node.

    ``about`` is roughly the number of links, as far as it is known; it sets the first partitions only."""
    edges = _contract(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), about)
    before = None
    while True:
        n, state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, state) == before or edges.rdd.getNumPartitions() == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = n, state
        edges = _contract(edges if n <= ROWS else _small_star(_large_star(edges)), n)
