"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transpark.session import materialize

# Bytes up to which a derived side table (cuts, offsets, first rows per group, vocabularies) is
# broadcast. Above it the join shuffles and AQE handles skewed keys.
BROADCAST_BYTES = 32 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of the rows: their text form plus a fixed part per row."""
    r = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.count(F.lit(1))).first()
    return int(r[0] or 0) + 32 * int(r[1])


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int | None = None) -> DataFrame:
    """Join a derived table whose size is checked first: broadcast when it is small, shuffle otherwise."""
    small = materialize(small, "side")
    if table_bytes(small) <= (BROADCAST_BYTES if max_bytes is None else max_bytes):
        small = F.broadcast(small)
    return big.join(small, on, how)
