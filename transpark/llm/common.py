"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.session import checkpoint_dir

#: Rows of one Arrow batch: texts may be very long, so batches are kept short.
ARROW_ROWS = 500


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, unless the session already sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` of every Arrow batch (a dict of columns or None), with bounded batches."""
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


class Scratch:
    """Parquet tables under the shared checkpoint folder that cut lineage, dropped when replaced."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, what: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{what}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            self.discard(df._scratch)

    def discard(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: PySpark gives all its workers one PYTHONHASHSEED; then bytes have one (64-bit SipHash) hash everywhere.
_word_hash = hash if os.environ.get("PYTHONHASHSEED", "").isdigit() else xxhash.xxh3_64_intdigest


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in all workers of a session."""
    kind = np.int64 if _word_hash is hash else np.uint64
    return np.fromiter(map(_word_hash, tokens), kind, len(tokens)).view(np.uint64)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs of Spark."""
    return x.view(np.int64)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``: the fixed folds of held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
