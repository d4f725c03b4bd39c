"""Dense row numbering without a global window.

``row_number()`` over an un-partitioned window sends every row through one
task, and a window partitioned by a hot key does the same for that key. Here
rows are range-partitioned on the full sort key (a hot key is split across
many ranges because the rest of the key differs), sorted inside each range,
written once as Parquet with range and position under the checkpoint folder,
and numbered as ``offset(range) + position in range``. The offsets table has
one row per range, which is bounded by the partition count, not by the data.
Columns that are not selected afterwards are not read back; callers number
narrow rows where they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transpark.operators.common import join_small
from transpark.session import TEXT_CODEC, materialize

_MID_SHIFT = 33  # monotonically_increasing_id = partition index << 33 | row position


def _key_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _ranged(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """Rows in key order with ``_tp_pid`` (range) and ``_tp_pos`` (position in it), written once."""
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    pos = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), _MID_SHIFT)
    return materialize(ranged.select("*", pid.alias("_tp_pid"), pos.alias("_tp_pos")), "ranged", TEXT_CODEC)


def _join_groups(df: DataFrame, of_groups: DataFrame, part: list[str]) -> DataFrame:
    """Rows with what is known of their group; a null group is a group like others."""
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_tp_g{i}"))
    names = [F.col(c).alias(f"_tp_g{i}") for i, c in enumerate(part)]
    of_groups = of_groups.select(*names, *[c for c in of_groups.columns if c not in part])
    return join_small(df, of_groups, same).drop(*[f"_tp_g{i}" for i in range(len(part))])


def _offsets(ranged: DataFrame, weight: Column) -> DataFrame:
    """``_tp_pid, _tp_off``: the sum of ``weight`` in the ranges before (one row per range)."""
    before = Window.orderBy("_tp_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_tp_pid").agg(F.sum(weight).cast("long").alias("_tp_sum"))
    return sums.select("_tp_pid", F.coalesce(F.sum("_tp_sum").over(before), F.lit(0)).alias("_tp_off"))


def dense_index(
    df: DataFrame,
    order_by: list,
    partition_by: list[str] | None = None,
    name: str = "idx",
    start: int = 0,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = rank of the row in ``order_by`` order (0-based + ``start``).

    With ``partition_by`` the numbering restarts for every group. The order key
    must be total (unique) for the result to be deterministic. The input is
    evaluated twice (range bounds are sampled from it), so an expensive input
    should be materialized first.
    """
    part = list(partition_by or [])
    keys = _key_cols([*part, *order_by])
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(df, keys, n)
    out = join_small(ranged, _offsets(ranged, F.lit(1)), "_tp_pid").withColumn(name, F.col("_tp_off") + F.col("_tp_pos"))
    if part:
        firsts = out.groupBy(*part).agg(F.min(name).alias("_tp_first"))
        out = _join_groups(out, firsts, part).withColumn(name, F.col(name) - F.col("_tp_first")).drop("_tp_first")
    out = out.drop("_tp_pid", "_tp_pos", "_tp_off")
    if start:
        out = out.withColumn(name, F.col(name) + F.lit(start))
    return out


def number_by_key(df: DataFrame, keys: list[str], partition_by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Like ``dense_index`` in order of ``keys`` (which are unique within a group), but only the keys go
    through the range sort; the numbers are joined back to the rows. Null keys are keys like others;
    repeated ones raise an error."""
    part = list(partition_by or [])
    every = [*part, *keys]
    numbered = dense_index(df.select(*every), keys, partition_by=part, name=name)
    numbered = numbered.select(*[F.col(c).alias(f"_tp_k{i}") for i, c in enumerate(every)], name)
    if not numbered.groupBy(*[f"_tp_k{i}" for i in range(len(every))]).count().filter("count > 1").isEmpty():
        raise ValueError(f"{every} do not identify a row")
    same = F.lit(True)
    for i, c in enumerate(every):
        same = same & F.col(c).eqNullSafe(F.col(f"_tp_k{i}"))
    return df.join(numbered, same).drop(*[f"_tp_k{i}" for i in range(len(every))])


def prefix_sum(
    df: DataFrame,
    order_by: list,
    weight: str,
    partition_by: list[str] | None = None,
    name: str = "cum",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = inclusive running sum of ``weight`` in ``order_by`` order (restarting per
    ``partition_by`` group), computed without a single-task window: rows are range-partitioned on
    the full key, each range sums its rows (a window per range), and ranges are offset by the
    totals of the ranges before them (one row per range)."""
    part = list(partition_by or [])
    keys = _key_cols([*part, *order_by])
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(df, keys, n)
    w = Window.partitionBy("_tp_pid").orderBy("_tp_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = join_small(ranged, _offsets(ranged, F.col(weight)), "_tp_pid").withColumn("_tp_run", F.sum(weight).over(w))
    out = out.withColumn(name, F.col("_tp_off") + F.col("_tp_run"))
    if part:
        starts = out.groupBy(*part).agg(F.min(F.col(name) - F.col(weight)).alias("_tp_start"))
        out = _join_groups(out, starts, part).withColumn(name, F.col(name) - F.col("_tp_start")).drop("_tp_start")
    return out.drop("_tp_pid", "_tp_pos", "_tp_run", "_tp_off")
