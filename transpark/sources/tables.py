"""Parquet tables with enough scan parallelism for per-row text work.

A Parquet file is split at row-group boundaries, so a file written as one
row group is read by one task however large it is. Spreading it with a
shuffle after the scan does not help much: Catalyst pushes filters (and the
expressions they use) below the shuffle, back into the single scan task.
Such an input of at most ``RELAY_BYTES`` is re-laid as several files under the
checkpoint folder; scans then run in parallel and predicates still reach the
Parquet reader. Larger inputs are read as they are. A re-laid copy serves
again only while the files of the table (names, sizes, modification times as
the Hadoop file system tells them) are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transpark.session import materialize

RELAY_BYTES = 256 << 20

_RELAID: dict[tuple, DataFrame] = {}


def _files(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def read_table(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    files = _files(spark, path)
    if sum(size for _, size, _ in files) > RELAY_BYTES:
        return df
    key = (spark.sparkContext.applicationId, want, files)
    if key not in _RELAID:
        _RELAID[key] = materialize(df.repartition(want), "relaid", shared=True)
    return _RELAID[key]
