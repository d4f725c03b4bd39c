"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

On a cluster the folder for lineage cuts comes from ``spark.checkpoint.dir``
(set by whoever runs the cluster). Only a local master without that setting
gets a private scratch folder, which is what tests and the bench use.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "transpark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # workers beyond those of one step (a step that feeds another has its own) would each load a model of their own
        .config("spark.python.factory.idleWorkerMaxPoolSize", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.driver.memory", os.environ.get("TRANSPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; sets it up only where it is unset on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="transpark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with one content, complete under its name or not there at all."""
    jvm = spark._jvm
    goal = jvm.org.apache.hadoop.fs.Path(path)
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    made = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(goal, False)
    if not fs.rename(made, goal):
        raise OSError(f"{made} could not be renamed to {goal}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


#: For stored copies of texts that are as large as the input, or that stay.
TEXT_CODEC = "zstd"

_WRITTEN: list[str] = []  # intermediate tables of this process, for release()
_OF_STEP: ContextVar[list[str] | None] = ContextVar("_OF_STEP", default=None)  # those of a temporary() block

_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where what materialize() returned is stored

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that runs inside go when it ends; otherwise they stay until the driver happens to collect
    garbage. For writes, whose shuffles nothing reads again."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str = "part", codec: str | None = None, shared: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back (lineage cut, columnar re-reads);
    ``codec`` other than the session's for what is large and stays; ``shared`` tables outlive temporary() blocks."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tp-{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.mode("overwrite").options(**({"compression": codec} if codec else {})).parquet(path)
    _WRITTEN.append(path)
    if (of_step := _OF_STEP.get()) is not None and not shared:
        of_step.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside (by this thread) go at the end: for a step whose result is stored by then."""
    token = _OF_STEP.set([])
    try:
        yield
    finally:
        paths = _OF_STEP.get()
        _OF_STEP.reset(token)
        for p in paths:
            _forget(spark, p)


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialize()`` returned, which nothing reads any more."""
    _forget(df.sparkSession, _PATH_OF.pop(df))


def _forget(spark: SparkSession, path: str) -> None:
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; for use once the results that read them are stored."""
    paths = list(_WRITTEN)
    _WRITTEN.clear()
    return sum(delete(spark, p) for p in paths)
