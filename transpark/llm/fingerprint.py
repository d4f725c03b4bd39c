"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (line ends, then clause ends; long runs without any are cut after words
that their own hash selects) and each distinct paragraph has a 64-bit digest. A sketch of m cells
holds, for the three cells of every digest, a count, the xor of digests and the xor of check values.
Subtracting two sketches cancels what both texts share; peeling cells that hold one digest recovers
the digests on which they differ. When peeling gets stuck, both sketches are built anew four times as
large (from the digests, in the same task) until the difference is whole.

likeness = shared / (shared + different) digests, where shared follows from the two sets' sizes and
the recovered difference. Two texts without paragraphs are alike (1.0).
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import mix64, small_batches

CELLS = 24  # cells of the published fingerprint and of the first attempt
HASHES = 3
LONG_PIECE = 200  # bytes from which a paragraph is cut further, after words chosen by their hash
CUT_EVERY = 8
RANGES = 65_536  # id ranges at most: their bounds are part of the plan; larger tables have larger ranges

_PIECE = re.compile(rb"[^.!?,;:|\n]+[.!?,;:|\n]*|[.!?,;:|\n]+")
_U = np.uint64


def paragraphs(text: str) -> list[bytes]:
    """The paragraphs of a text, without the white space around them."""
    out = []
    for piece in _PIECE.findall(text.encode("utf-8", "surrogatepass")):
        piece = piece.strip()
        if len(piece) <= LONG_PIECE:
            if piece:
                out.append(piece)
            continue
        run: list[bytes] = []
        for word in piece.split():
            run.append(word)
            if xxhash.xxh3_64_intdigest(word) % CUT_EVERY == 0:
                out.append(b" ".join(run))
                run = []
        if run:
            out.append(b" ".join(run))
    return out


def digests(text: str) -> np.ndarray:
    """Sorted distinct 64-bit digests of the paragraphs."""
    got = {xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)}
    return np.sort(np.fromiter(got, np.uint64, len(got)))


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ _U(0x5BF03635D1F2A8C1)) >> _U(32)).astype(np.uint32)


def _cells(keys: np.ndarray, base: np.ndarray, sub: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The cells of every key: one in each third of the sketch at ``base`` with thirds of ``sub`` cells."""
    out = np.empty((HASHES, len(keys)), np.int64)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            h = mix64(keys + seed * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03 * (j + 1) % 2**64))
            out[j] = base + j * sub + (h % sub.astype(np.uint64)).astype(np.int64)
    return out


def _insert(counts, xors, checks, cells, keys, sign) -> None:
    marks = _checks(keys)
    for row in cells:
        np.add.at(counts, row, sign)
        np.bitwise_xor.at(xors, row, keys)
        np.bitwise_xor.at(checks, row, marks)


def sketch(keys: np.ndarray, cells: int = CELLS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, digest xors, check xors) of one set of digests."""
    n = cells // HASHES * HASHES
    out = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    where = _cells(keys, np.zeros(len(keys), np.int64), np.full(len(keys), n // HASHES), np.full(len(keys), seed, np.uint64))
    _insert(*out, where, keys, np.ones(len(keys), np.int32))
    return out


def fingerprint(keys: np.ndarray) -> str:
    """``n:base64`` of the sketch with ``CELLS`` cells (counts, xors, checks, little-endian)."""
    return f"{len(keys)}:" + base64.b64encode(b"".join(x.tobytes() for x in sketch(keys))).decode()


def _peel(left: list[np.ndarray], right: list[np.ndarray], cells: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch both sets of every pair, subtract, peel. (number of differing digests, whole?) of each pair."""
    n = len(left)
    sub = cells // HASHES
    start = np.concatenate([[0], np.cumsum(sub * HASHES)])
    pair_of_cell = np.repeat(np.arange(n), sub * HASHES)
    counts, xors, checks = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.uint64), np.zeros(start[-1], np.uint32)
    at = lambda keys, pair: _cells(keys, start[pair], sub[pair], np.full(len(pair), seed, np.uint64))
    for sets, sign in ((left, 1), (right, -1)):
        pair = np.repeat(np.arange(n), [len(x) for x in sets])
        keys = np.concatenate([*sets, np.empty(0, np.uint64)])
        _insert(counts, xors, checks, at(keys, pair), keys, np.full(len(keys), sign, np.int32))
    found = np.zeros(n, np.int64)
    look = np.arange(len(counts))
    while True:
        pure = look[(np.abs(counts[look]) == 1) & (checks[look] == _checks(xors[look]))]
        if not len(pure):
            break
        order = np.lexsort((xors[pure], pair_of_cell[pure]))
        pure = pure[order]
        keys, pair = xors[pure], pair_of_cell[pure]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1])])
        pure, keys, pair = pure[first], keys[first], pair[first]
        sign = counts[pure].copy()
        np.add.at(found, pair, 1)
        where = at(keys, pair)
        _insert(counts, xors, checks, where, keys, -sign)
        look = np.unique(where)
    left_over = np.zeros(n, bool)
    left_over[pair_of_cell[(counts != 0) | (xors != 0)]] = True
    return found, ~left_over


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Likeness of every pair of digest sets by subtracting and peeling, retrying larger on failure."""
    n_left, n_right = (np.array([len(x) for x in s], np.int64) for s in (left, right))
    diff = np.zeros(len(left), np.int64)
    todo, size, seed = np.arange(len(left)), np.full(len(left), cells, np.int64), 0
    while len(todo):
        got, whole = _peel([left[i] for i in todo], [right[i] for i in todo], size[todo], seed)
        diff[todo[whole]] = got[whole]
        todo = todo[~whole]
        size[todo] *= 4
        seed += 1
    both = (n_left + n_right - diff) // 2
    union = both + diff
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def _above(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the value: a tree of comparisons (null: null)."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    count = lambda of: F.aggregate(of, F.lit(0), lambda n, b: n + (value < b).cast("int"))
    tops = F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]])
    parts = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + step]]) for i in range(0, len(bounds) + 1, step)])
    whole = count(tops)
    return whole * step + count(F.element_at(parts, whole + 1))


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Documents with ``_bucket`` (ascending as ids descend) and ``_border`` (1: a copy of the row that
    follows the bucket's last one)."""
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(x) for x in (docs.stat.approxQuantile("doc_id", probs, 0.25 / buckets) if probs else [])}, reverse=True)
    out = docs.withColumn("_bucket", F.coalesce(_above(F.col("doc_id"), bounds), F.lit(len(bounds) + 1))).withColumn("_border", F.lit(0))
    firsts = sorted((r[0], r[1]) for r in out.groupBy("_bucket").agg(F.max("doc_id")).collect())  # a row per bucket
    if not firsts:
        return out, 0
    follows = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    known = docs.sparkSession.createDataFrame([x for x in follows if x[0] is not None], "doc_id long, _bucket int") if any(x[0] is not None for x in follows) else None
    if known is not None:
        heads = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "_bucket", F.lit(1).alias("_border"))
        out = out.unionByName(heads)
    for doc_id, b in follows:
        if doc_id is None:  # rows without an id come last; the first of them by text follows
            head = docs.where("doc_id is null").orderBy(F.coalesce("text", F.lit(""))).limit(1)
            out = out.unionByName(head.withColumn("_bucket", F.lit(b)).withColumn("_border", F.lit(1)))
    return out, len(firsts)


def with_next(docs: DataFrame, fn, schema: str, partitions: int | None = None) -> DataFrame:
    """``fn(ids, texts, next texts)`` of blocks of documents, where the next document has the next
    smaller ``doc_id`` (after the last: the first). Equal ids follow in order of text, null ids come
    last. The texts move once: to id ranges, to each of which a copy of the row after it is added.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), min(4 * partitions, RANGES))
    rows = rows.repartition(partitions, "_bucket").sortWithinPartitions("_bucket", "_border", F.col("doc_id").desc_nulls_last(), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose next one has not come yet
        for batch in it:
            block: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "_bucket", "_border"))):
                if held is not None:
                    block.append((held[0], held[1], row[1]))
                held = None if row[3] else row
            if block:
                yield pa.RecordBatch.from_pydict(fn(*map(list, zip(*block))))

    return rows.mapInArrow(run, schema)


def half_edited(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, now: list[str], after: list[str]) -> dict:
    edited = [half_edited(a, b) for a, b in zip(now, after)]
    sets = [digests(t) for t in now]
    sets_edited = [digests(t) for t in edited]
    sets_next = [*sets[1:], None]
    for i, t in enumerate(after):
        if sets_next[i] is None or now[i + 1] != t:
            sets_next[i] = digests(t)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": [len(t) for t in now],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [fingerprint(x) for x in sets],
        "edited_fingerprint": [fingerprint(x) for x in sets_edited],
        "near_edited": likeness(sets, sets_edited),
        "near_next": likeness(sets, sets_next),
    }


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (null: empty), of its edited text, and the likeness of both and of the
    next document. An empty table gives an empty result; repeated ids each have a row."""
    return with_next(docs, _compare, SCHEMA)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transpark.llm.common import table

    return document_fingerprints(table(spark, sf_dir, "documents"))
