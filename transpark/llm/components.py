"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are aggregations and joins on node ids, so neither links nor components ever meet on the
driver, and the number of rounds is logarithmic in the longest chain. Before them, one pass joins
the links of every partition in memory (a spanning forest of at most as many links as it read), which
shortens chains. Every round is written under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transpark.llm.common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, without the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking onto smaller roots, then pointer jumping
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = np.empty(0, np.int64)
    b = np.empty(0, np.int64)
    for batch in it:
        x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    if len(a):
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """``id, component`` (smallest id reachable) for every node of the links ``a, b`` (longs).

    Nodes without links do not appear; null ends, self-links and repeated links are ignored. An empty
    edge table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    links = edges.select("a", "b").where("a <> b")
    links = scratch.write(links.mapInArrow(_local, "a long, b long").where("a is not null"), "links")
    for _ in range(max_rounds):
        # large-star: every neighbour above u is linked to the smallest node around u
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every node's smaller neighbours and itself are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.write(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        # done when no node is both a child and a root, and every child has one root
        odd = new.groupBy("a").count().where("count > 1").select("a").union(new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi"))
        done = odd.isEmpty()
        scratch.drop(links)
        links = new
        if done:
            roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
    raise RuntimeError(f"links did not settle within {max_rounds} rounds")
