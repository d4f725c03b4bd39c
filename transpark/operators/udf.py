"""Pluggable batch functions (U1-U3): translation, teacher translation and
learned segment scores run as ``mapInArrow`` jobs. Only ``SLICE`` rows of an Arrow batch, and only the
columns a function needs, are Python objects at a time.

The user passes ``make_fn()``, called once per Python worker (it loads a model
or opens a client), returning ``fn(list[str]) -> list[str]`` (or a scorer). A worker
keeps the ``MODELS`` functions it used last, known by what ``make_fn`` is: calls
with the same function share one load, whatever the number of jobs, and a function that makes room
for another has its ``close()`` called if it has one. Every input row comes out
exactly once with its key; the output count is checked per batch. Spark bounds an
Arrow batch in rows and in bytes (``spark.sql.execution.arrow.maxRecordsPerBatch``,
``maxBytesPerBatch``). No network client or model ships with this package.
"""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from transpark.functions.text import strip, unescape

MODELS = 2  # a forward and a backward one
SLICE = 256  # rows, or one batch of the function if that is larger
_LOADED: OrderedDict[str, object] = OrderedDict()  # of this worker: what make_fn() returned, last used last


def identity(make_fn: Callable) -> str:
    """What a function is: its name where workers import it, otherwise its code and what it refers to."""
    return hashlib.sha256(cloudpickle.dumps(make_fn)).hexdigest()


def loaded(name: str, make_fn: Callable, models: int = MODELS):
    """What ``make_fn()`` returns, from this worker's cache of the ``models`` last used ones."""
    # imported by name: a function sent to a worker would carry a copy of the table otherwise
    from transpark.operators import udf

    cache = udf._LOADED
    if name in cache:
        cache.move_to_end(name)
        return cache[name]
    while len(cache) >= max(models, 1):  # before the new one is loaded, so that there are never more
        _, old = cache.popitem(last=False)
        if callable(close := getattr(old, "close", None)):
            close()
        del old
    cache[name] = made = make_fn()
    return made


def _chunks(values: list, size: int):
    for i in range(0, len(values), size):
        yield values[i : i + size]


def _slices(batches, batch_size: int):
    """Parts of Arrow batches, each a whole number of ``batch_size`` rows but for the last of a batch."""
    rows = batch_size * max(1, SLICE // batch_size)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _texts(part: pa.RecordBatch, col: str) -> list[str]:
    return ["" if t is None else t for t in part.column(col).to_pylist()]


def _with_column(part: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, name])


def _call_with_retries(fn, batch, retries: int, backoff: float):
    for attempt in range(retries + 1):
        try:
            return fn(batch)
        except Exception:  # noqa: BLE001
            if attempt == retries:
                raise
            time.sleep(backoff * (2**attempt))
    raise RuntimeError("unreachable")


def translate_corpus(
    df: DataFrame,
    make_fn: Callable[[], Callable[[list[str]], list[str]]],
    src_col: str = "src",
    out_col: str = "hyp",
    batch_size: int = 32,
    retries: int = 0,
    backoff: float = 1.0,
    max_parallel: int | None = None,
) -> DataFrame:
    """``out_col`` = fn(``src_col``) in batches of ``batch_size`` rows; all other columns kept."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), True)])
    name, models = identity(make_fn), MODELS

    def run(batches):
        fn = loaded(name, make_fn, models)
        for part in _slices(batches, batch_size):
            outs: list[str] = []
            for chunk in _chunks(_texts(part, src_col), batch_size):
                got = list(_call_with_retries(fn, chunk, retries, backoff))
                if len(got) != len(chunk):
                    raise ValueError(f"translation returned {len(got)} rows for {len(chunk)}")
                outs.extend(got)
            yield _with_column(part, out_col, pa.array(outs, pa.string()))

    src = df.repartition(max_parallel) if max_parallel else df
    return src.mapInArrow(run, schema)


def teacher_translate(
    df: DataFrame,
    make_fn: Callable[[], Callable[[list[str]], list[str]]],
    src_col: str = "src",
    out_col: str = "hyp",
    batch_size: int = 1000,
    retries: int = 3,
    backoff: float = 1.0,
    max_parallel: int | None = None,
) -> DataFrame:
    """Strip the source, translate with retries (errors raise after the last try),
    unescape HTML references in the output."""
    stripped = df.withColumn("_tp_src", strip(src_col))
    out = translate_corpus(stripped, make_fn, "_tp_src", out_col, batch_size, retries, backoff, max_parallel)
    return out.withColumn(out_col, unescape(out_col)).drop("_tp_src")


def score_segments(
    df: DataFrame,
    make_scorer: Callable[[], Callable[[list[str], list[str], list[str]], list[float]]],
    src: str = "src",
    hyp: str = "hyp",
    ref: str = "ref",
    out_col: str = "seg_score",
    batch_size: int = 64,
) -> DataFrame:
    """Learned segment score of (source, hypothesis, reference)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType(), True)])
    name, models = identity(make_scorer), MODELS

    def run(batches):
        scorer = loaded(name, make_scorer, models)
        for part in _slices(batches, batch_size):
            cols = [_texts(part, c) for c in (src, hyp, ref)]
            outs: list[float] = []
            for i in range(0, part.num_rows, batch_size):
                got = list(scorer(*(c[i : i + batch_size] for c in cols)))
                if len(got) != min(batch_size, part.num_rows - i):
                    raise ValueError("scorer returned a different number of rows")
                outs.extend(float(x) for x in got)
            yield _with_column(part, out_col, pa.array(outs, pa.float64()))

    return df.mapInArrow(run, schema)


# --- deterministic stand-ins used by tests and the registered queries --------


def reverse_words_translator():
    """Toy translator: the words of the sentence in reverse order."""

    def fn(texts: list[str]) -> list[str]:
        return [" ".join(reversed(t.split())) for t in texts]

    return fn


def escaping_reverse_translator():
    """Toy teacher: like ``reverse_words_translator`` but returns HTML-escaped text."""
    import html

    def fn(texts: list[str]) -> list[str]:
        return [html.escape(" ".join(reversed(t.split())), quote=True) for t in texts]

    return fn


def overlap_scorer():
    """Toy segment metric: share of distinct reference words that the hypothesis has."""

    def fn(srcs: list[str], hyps: list[str], refs: list[str]) -> list[float]:
        out = []
        for h, r in zip(hyps, refs):
            rs = set(r.split())
            out.append(len(set(h.split()) & rs) / len(rs) if rs else 0.0)
        return out

    return fn

