"""Importance resampling towards a target distribution, by hashed n-gram features.

The features of a text are its runs of 1 to ``max_n`` consecutive words, joined by one space, repeats
counted; a feature falls into the bucket crc32(UTF-8 bytes) modulo ``buckets``. With s of S features of the
source in a bucket and t of T of the target, the bucket's gain is
floor(1000*ln((t+1)*(S+buckets)/((s+1)*(T+buckets)))). A document weighs the sum of its features' gains;
Gumbel noise drawn from a hash of its id is added, and the documents of at least ``min_words`` words with the
highest scores, ``percent`` of them, are drawn: sampling without replacement in proportion to exp(weight/1000).

Per Arrow batch the words are split and dictionary-encoded by Arrow kernels. The dictionary codes, shifted
against each other, make the n-grams; each distinct n-gram is hashed once, and the buckets of all others are
taken from there. A document's gains are summed by a segment reduction. Texts are read twice (counts, then
scores); what moves between tasks is one number for a bucket and task, and narrow scores.

Null and empty texts have no features and weigh nothing. Documents with fewer words than ``min_words`` are
returned undrawn. A null id draws its noise as ``null`` and comes after other ids in ties. Repeated rows are
documents of their own, with equal scores. Empty tables count nothing; an empty source returns no rows.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.arrow_words import split_words
from transpark.llm.common import Scratch, map_batches, small_batches, table
from transpark.operators.numbering import dense_index

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024


def _ngrams(codes: np.ndarray, rows: np.ndarray, vocabulary: list[bytes], max_n: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For n from 1 to ``max_n``: the distinct n-grams, and for each n-gram in text order its code and row."""
    grams, at = vocabulary, codes  # at[i]: the code of the n-gram that begins with word i
    yield grams, at, rows
    for n in range(2, max_n + 1):
        starts = np.flatnonzero(rows[n - 1 :] == rows[: max(0, len(rows) - n + 1)])
        pairs, found = np.unique(at[starts] * len(vocabulary) + codes[starts + n - 1], return_inverse=True)
        grams = [grams[p // len(vocabulary)] + b" " + vocabulary[p % len(vocabulary)] for p in pairs.tolist()]
        at = np.zeros(len(codes), np.int64)
        at[starts] = found
        yield grams, found, rows[starts]


def feature_buckets(column: pa.Array, max_n: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of every feature, in the order of rows, and the number of words of each row."""
    vocabulary, codes, rows = split_words(column)
    found = []
    for grams, at, of in _ngrams(codes, rows, [w.encode("utf-8") for w in vocabulary.to_pylist()], max_n):
        hashed = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(grams))
        found.append((hashed.take(at), of))
    bucket, row = (np.concatenate(x) for x in zip(*found))
    if max_n > 1:
        order = np.argsort(row, kind="stable")
        bucket, row = bucket[order], row[order]
    return bucket, row, np.bincount(rows, minlength=len(column))


def bucket_counts(df: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all features of the texts: every task counts its own, and sums move."""
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in it:
            counts += np.bincount(feature_buckets(batch.column("text"), max_n, buckets)[0], minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": there.astype(np.int32), "n": counts[there]})

    return df.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket from the counts ``bucket, n`` of both sides (stored ones: they are
    read twice); one row a bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    big_s, big_t = (float(df.agg(F.sum("n")).first()[0] or 0) for df in (source, target))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln((t + 1) * (big_s + buckets) / ((s + 1) * (big_t + buckets)))).alias("gain"))


def importance_scores(docs: DataFrame, gains: DataFrame, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of documents (``doc_id, text``)."""
    of = np.zeros(buckets, np.int64)
    for r in gains.collect():  # one row a bucket
        of[r["bucket"]] = r["gain"]

    def score(batch: pa.RecordBatch) -> dict:
        bucket, row, n_words = feature_buckets(batch.column("text"), max_n, buckets)
        n = np.bincount(row, minlength=batch.num_rows)
        weight = np.zeros(batch.num_rows, np.int64)
        there = np.flatnonzero(n)
        if len(there):
            starts = np.concatenate(([0], np.cumsum(n[there])[:-1]))
            weight[there] = np.add.reduceat(of.take(bucket), starts)
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_features": n, "weight": weight}

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the drawn ones have a rank from 1."""
    scratch = Scratch(docs.sparkSession, "importance")
    source, wanted = (scratch.write(bucket_counts(df, max_n, buckets), "counts") for df in (docs, target))
    gains = bucket_gains(source, wanted, buckets)
    scores = scratch.write(importance_scores(docs, gains, max_n, buckets, seed), "scores")
    fit = scores.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    tie = F.monotonically_increasing_id().alias("_row")  # equal scores and ids: spread over ranges like others
    ranked = dense_index(fit.select("*", tie), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")], name="rank", start=1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    short = scores.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).unionByName(short)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
