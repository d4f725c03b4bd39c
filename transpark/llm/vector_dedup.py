"""Embedding near-dedup by sorted projection passes.

Every pass draws ``BITS`` random hyperplanes, orders all vectors lexicographically by the concatenated
signs, and compares each vector with the ``WINDOW`` next ones; pairs whose cosine reaches the threshold
are linked, and the links of all passes are united to components. Neighbours on either side of a task's
border meet in other passes, whose borders lie elsewhere.

How many passes bring a pair together depends on how dense its surroundings are. So passes are repeated in
turns of ``PASSES``, with new hyperplanes, until a turn joins no more than ``1 - RECALL`` of what all turns
after the first have joined (in a table without dense groups the second turn joins nothing and is the last).

Bit-identical vectors are first folded to one class with a count, so that copies don't fill windows, and a
task passes on a spanning forest of the links it verified. Afterwards every component is compared in full,
in blocks of ``BLOCK`` vectors, to count the links of each vector: within a component no link is missed.
That comparison grows with the square of a component, spread over its pairs of blocks.

Components of vectors stay as they are, 32-bit or 64-bit floats, and are compared in double precision, scaled by a
power of two so that neither very large nor very small ones overflow. Vectors that are null, zero or hold
null or non-finite components link with nothing. Rows with one vec_id are one vector to the links, linked
with whatever one of them is linked with; links count different other vec_ids. Where ids stand on rows of
different vectors, the links of those vectors are listed pair by pair to count them. A row without vec_id is
returned unlinked and is not kept. Every row is returned, repeated ones as often as they occur; an empty table
gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import Scratch, table
from transpark.llm.components import connected_components, forest

THRESHOLD = 0.95
PASSES = 24  # of a turn
RECALL = 0.999
BITS = 63
WINDOW = 64
BLOCK = 2048
SEED = 20_240_607


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(np.array(column.to_pylist(), np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(vectors: DataFrame, passes: range, bits: int) -> DataFrame:
    """``pass, size, order, id, embedding``: the concatenated signs of every pass as one long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(batch.column("embedding").to_pylist()):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                part = batch.take(pa.array(rows))
                x = _matrix(part.column("embedding"))
                for p in passes:
                    planes = np.random.default_rng([SEED, p, size]).standard_normal((size, bits))
                    order = ((x @ planes) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_pydict({"pass": pa.array(np.full(len(rows), p), pa.int32()), "size": pa.array(np.full(len(rows), size), pa.int32()), "order": order, "id": part.column("id"), "embedding": part.column("embedding")})

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"pass int, size int, order long, id long, embedding {kind}")


def _windows(threshold: float, window: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, x = None, np.empty(0, np.int64), None
        for batch in it:
            keys = np.stack([batch.column(k).to_numpy() for k in ("pass", "size")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                y, y_ids = _matrix(part.column("embedding")), part.column("id").to_numpy()
                if group == tuple(keys[a]):  # goes on from the batch before
                    y, y_ids = np.concatenate([x[-window:], y]), np.concatenate([ids[-window:], y_ids])
                group, ids, x = tuple(keys[a]), y_ids, y
                left, right = [], []
                for d in range(1, min(window, len(y) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", y[:-d], y[d:]) >= threshold)
                    left.append(y_ids[near])
                    right.append(y_ids[near + d])
                if left:
                    u, v = forest(np.concatenate(left), np.concatenate(right))
                    if len(u):
                        yield pa.RecordBatch.from_pydict({"a": u, "b": v})

    return run


def _counted(threshold: float):
    """``id, links`` (ids of one vector alone in the linked classes, its own class included) by pair of blocks,
    with ``other`` null; and the pairs ``id, other`` of linked classes of which one has ids of several vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        side = pdf["block"].to_numpy()
        sides = [pdf[side == i], pdf[side == j]]
        out = []
        for own, other in ((sides[0], sides[1]), (sides[1], sides[0]))[: 1 if i == j else 2]:
            if not len(own) or not len(other):
                continue
            x, y = (_unit(np.stack([np.asarray(v, np.float64) for v in s["embedding"]])) for s in (own, other))
            near = (x @ y.T) >= threshold
            if i == j:
                np.fill_diagonal(near, True)
            links = near.astype(np.float64) @ other["copies"].to_numpy(np.float64)
            out.append(pd.DataFrame({"id": own["id"].to_numpy(), "links": links.astype(np.int64), "other": pd.array([pd.NA] * len(own), "Int64")}))
            near &= own["several"].to_numpy()[:, None] | other["several"].to_numpy()[None, :]
            a, b = np.nonzero(near)
            if len(a):
                out.append(pd.DataFrame({"id": own["id"].to_numpy()[a], "links": 0, "other": pd.array(other["id"].to_numpy()[b], "Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "other": pd.array([], "Int64")})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding`` (an array of numbers)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False))
    classes = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("first"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    of_ids = rows.where(sound).join(classes, "embedding").groupBy("vec_id", "id").agg(F.lit(1).alias("one")).select("vec_id", "id")
    of_ids = scratch.write(of_ids, "ids")
    # ids of several vectors, with the classes that they tie together
    several = of_ids.groupBy("vec_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    tied = scratch.write(of_ids.join(several, "vec_id").select("vec_id", "id", "low"), "tied")
    copies = of_ids.join(several, "vec_id", "left_anti").groupBy("id").agg(F.count("*").alias("copies"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    component, joined, late, turn = None, 0, 0, 0
    while True:
        sorted_ = _signed(classes, range(turn * passes, (turn + 1) * passes), bits).repartitionByRange(n, "pass", "size", "order", "id").sortWithinPartitions("pass", "size", "order", "id")
        edges = sorted_.mapInArrow(_windows(threshold, window), "a long, b long").distinct()
        if component is None:
            edges = edges.union(tied.select("id", "low"))
        else:
            edges = edges.union(component.select("id", "component"))
        edges = scratch.write(edges, "edges")
        before, component = component, scratch.write(connected_components(edges, scratch), "components")
        scratch.drop(edges, *([] if before is None else [before]))
        new = component.where("id <> component").count() - joined
        joined, late = joined + new, late + (new if turn else 0)
        if turn and new <= (1 - RECALL) * late:
            break
        turn += 1
    # full comparison inside components, block against block
    classes = classes.join(copies, "id", "left").join(tied.select("id", F.lit(True).alias("several")).distinct(), "id", "left")
    classes = classes.select("id", "first", "embedding", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("several", F.lit(False)).alias("several"))
    members = classes.join(component, "id").select("id", "copies", "several", "embedding", "component")
    sizes = component.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "several", "embedding")
    links = dealt.groupBy("component", "i", "j").applyInPandas(_counted(threshold), "id long, links long, other long")
    links = scratch.write(links, "links")
    # a class without links has its own ids alone
    own = classes.join(links.select("id").distinct(), "id", "left_anti").select("id", F.col("copies").cast("long").alias("links"))
    plain = links.where("other is null").groupBy("id").agg(F.sum("links").alias("links")).union(own)
    pairs = links.where("other is not null").select("id", "other")
    reached = pairs.join(tied.select(F.col("id").alias("other"), "vec_id"), "other")
    more = reached.groupBy("id").agg(F.countDistinct("vec_id").alias("more"))
    smallest = classes.join(component, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("id", "component_id")
    single = of_ids.join(several, "vec_id", "left_anti").join(plain, "id").join(more, "id", "left").join(smallest, "id")
    single = single.select("vec_id", (F.col("links") + F.coalesce("more", F.lit(0)) - 1).alias("n_links"), "component_id")
    # of an id of several vectors: the classes that any of them is linked with, once each
    around = tied.select("vec_id", "id").join(pairs, "id").select("vec_id", "other").distinct()
    alone = around.join(classes.select(F.col("id").alias("other"), "copies"), "other").groupBy("vec_id").agg(F.sum("copies").alias("links"))
    others = around.join(tied.select(F.col("id").alias("other"), F.col("vec_id").alias("w")), "other").groupBy("vec_id").agg(F.countDistinct("w").alias("more"))
    any_ = tied.join(smallest, "id").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    shared = any_.join(alone, "vec_id").join(others, "vec_id").select("vec_id", (F.col("links") + F.col("more") - 1).alias("n_links"), "component_id")
    found = single.unionByName(shared)
    out = rows.withColumn("_sound", sound)
    linked = out.where("_sound").join(found, "vec_id").select("vec_id", "n_links", "component_id")
    alone = out.where("not _sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
