"""BLEU as DataFrame jobs.

Public definition: Papineni et al. (2002) with the sacreBLEU defaults
(Post 2018): 13a tokens, case-sensitive, one reference, 4-grams,
exponential smoothing of zero match counts, brevity penalty exp(1 - r/h).

Plan: a segment is one row, and its statistics come from a ``mapInArrow`` job over the pairs. A task numbers
the tokens of a slice of texts (a word is cut into tokens once, not once for each place), the n-grams by
the number of their first n-1 tokens and of their last token, and counts both sides of all segments of the slice
at once. The numbers are exact: no two n-grams share one. No row is multiplied and nothing is shuffled below the
sums of groups; a task holds a few arrays of eight bytes a token of a slice.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transpark.functions.bleu13a import text_words, word_tokens

ORDER = 4
SLICE_BYTES = 1 << 20  # of the texts counted at once, but for one that is longer alone
WORD_CHARS = 1 << 25  # of the words a task remembers, 64 more for each


class _Numbers:
    """Numbers of words and of tokens, counted together. An alphanumeric word is its only token; ``code`` has the
    token of every other word that is one token, or a negative number, by which ``first`` and ``size`` tell
    where in ``flat`` its tokens are."""

    def __init__(self):
        count = itertools.count()
        self.words, self.tokens = defaultdict(count.__next__), defaultdict(count.__next__)
        self.code = np.arange(1 << 12)
        self.flat, self.first, self.size = array("q"), array("q"), array("q")
        self.chars = 0

    def _learn(self, seen: int) -> None:
        """What the words after the first ``seen`` ones are made of."""
        new = list(itertools.islice(reversed(self.words), len(self.words) - seen))
        self.chars += sum(map(len, new)) + 64 * len(new)
        cut = {}
        for word in new:
            if not word.isalnum():
                found = [self.words[t] if t.isalnum() else self.tokens[t] for t in word_tokens(word)]
                cut[self.words[word]] = found[0] if len(found) == 1 else -1 - len(self.first)
                if len(found) != 1:
                    self.first.append(len(self.flat))
                    self.size.append(len(found))
                    self.flat.extend(found)
        used = len(self.words) + len(self.tokens)
        if used > len(self.code):
            self.code = np.concatenate((self.code, np.arange(len(self.code), 2 * used)))
        self.code[list(cut.keys())] = list(cut.values())

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the tokens of texts one after the other, and how many tokens each text has."""
        seen, number = len(self.words), self.words.__getitem__
        parts = [np.fromiter(map(number, words), np.int64, len(words)) for words in map(text_words, texts)]
        self._learn(seen)
        words = self.code[np.concatenate([np.zeros(0, np.int64), *parts])]
        cut = np.flatnonzero(words < 0)
        flat, first, size = (np.array(a, np.int64) for a in (self.flat, self.first, self.size))
        n = np.ones(len(words), np.int64)
        n[cut] = size[-1 - words[cut]]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        tokens = np.repeat(words, n)
        place = np.repeat(first[-1 - words[cut]] - ends[cut], n[cut])
        of_cut = np.flatnonzero(tokens < 0)
        tokens[of_cut] = flat[place + of_cut]
        return tokens, np.diff(ends[np.cumsum([0, *map(len, parts)])])


def _matches(hyp: np.ndarray, hyp_len: np.ndarray, ref: np.ndarray, ref_len: np.ndarray) -> list[np.ndarray]:
    """Per segment and order the sum over distinct n-grams of the smaller of their numbers on both sides."""
    rows, tokens, lengths = len(hyp_len), np.concatenate((hyp, ref)), np.concatenate((hyp_len, ref_len))
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))  # tokens from here to the end of the text
    width = int(tokens.max(initial=0)) + 1
    gram, at, out = row.copy(), np.arange(len(tokens)), []
    for n in range(1, ORDER + 1):
        grams, of = np.unique(gram[at] * width + tokens[at + n - 1], return_inverse=True)
        is_ref = at >= len(hyp)
        both = np.minimum(*(np.bincount(of[side], minlength=len(grams)) for side in (~is_ref, is_ref)))
        row_of = np.zeros(len(grams), np.int64)
        row_of[of] = row[at]
        out.append(np.bincount(row_of, weights=both, minlength=rows).astype(np.int64))
        gram[at] = of
        at = at[(both[of] > 0) & (left[at] > n)]  # what begins with an n-gram of one side is of one side
    return out


def _texts(col: pa.Array) -> list[str]:
    try:
        return col.to_pylist()
    except UnicodeDecodeError:  # bytes that are no text, as the JVM reads them
        return [b.decode("utf-8", "replace") for b in col.cast(pa.binary()).to_pylist()]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column("_hyp")).to_numpy().astype(np.int64) + pc.binary_length(batch.column("_ref")).to_numpy()
    at = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    for i, j in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows]):
        yield batch.slice(i, j - i)


def segment_stats(df: DataFrame, hyp: str = "hyp", ref: str = "ref", keys: list[str] | None = None) -> DataFrame:
    """A2: per segment ``keys..., sys_len, ref_len, m1..m4, t1..t4``, one row for each row of ``df``.

    ``keys`` are carried along (e.g. ``["run", "idx"]``). Empty and null hypotheses
    still count their reference length.
    """
    keys = list(keys or ["idx"])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = df.select(*keys, text(hyp).alias("_hyp"), text(ref).alias("_ref"))
    schema = T.StructType([*pairs.schema.fields[: len(keys)], *[T.StructField(c, T.LongType()) for c in STAT_COLS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            for part in _slices(batch):
                if numbers.chars > WORD_CHARS:
                    numbers = _Numbers()
                h, h_len = numbers.of(_texts(part.column("_hyp")))
                r, r_len = numbers.of(_texts(part.column("_ref")))
                totals = [np.maximum(h_len - n, 0) for n in range(ORDER)]
                stats = [h_len, r_len, *_matches(h, h_len, r, r_len), *totals]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *map(pa.array, stats)], names=schema.names)

    return pairs.mapInArrow(run, schema)


STAT_COLS = ["sys_len", "ref_len", *[f"m{n}" for n in range(1, ORDER + 1)], *[f"t{n}" for n in range(1, ORDER + 1)]]


def sum_stats() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in STAT_COLS]


def bleu_from_sums(prefix: str = "") -> list[Column]:
    """Score columns from summed statistics: ``bleu, bp, p1..p4`` (percent, like sacreBLEU)."""
    c = lambda name: F.col(prefix + name)
    sys_len, ref_len = c("sys_len"), c("ref_len")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len)).otherwise(F.lit(0.0))
    m = [c(f"m{n}") for n in range(1, ORDER + 1)]
    t = [c(f"t{n}") for n in range(1, ORDER + 1)]
    prec = []
    zeros = F.lit(0)
    blocked = F.lit(False)  # an order without n-grams stops the loop; later orders stay 0
    for n in range(ORDER):
        blocked = blocked | (t[n] == 0)
        zeros = zeros + F.when(m[n] == 0, 1).otherwise(0)
        p = (
            F.when(blocked, F.lit(0.0))
            .when(m[n] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t[n]))
            .otherwise(F.lit(100.0) * m[n] / t[n])
        )
        prec.append(p)
    no_match = m[0] == 0
    for x in m[1:]:
        no_match = no_match & (x == 0)
    prec = [F.when(no_match, F.lit(0.0)).otherwise(p) for p in prec]
    logsum = F.log(prec[0])
    for p in prec[1:]:
        logsum = logsum + F.log(p)
    score = F.when(no_match | blocked, F.lit(0.0)).otherwise(bp * F.exp(logsum / F.lit(float(ORDER))))
    return [score.alias("bleu"), bp.alias("bp"), *[p.alias(f"p{n + 1}") for n, p in enumerate(prec)]]


def corpus_bleu(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: corpus BLEU per group (``by``) from segment statistics."""
    by = list(by or [])
    sums = stats.groupBy(*by).agg(*sum_stats())
    return sums.select(*by, *bleu_from_sums(), *STAT_COLS)


def batch_bleu(stats: DataFrame, batch_size: int, by: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """A4: BLEU of consecutive batches ``floor(idx / batch_size)`` (``idx`` dense from 0 per group)."""
    by = list(by or [])
    b = stats.withColumn("batch_id", F.floor(F.col(idx) / F.lit(batch_size)).cast("long"))
    return corpus_bleu(b, [*by, "batch_id"])


def bleu_mean_std(stats: DataFrame, batch_size: int, by: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """A5: mean and sample standard deviation of batch BLEU (NULL stdev for a single batch)."""
    by = list(by or [])
    return batch_bleu(stats, batch_size, by, idx).groupBy(*by).agg(
        F.avg("bleu").alias("bleu_mean"), F.stddev_samp("bleu").alias("bleu_std"), F.count("*").alias("n_batches")
    )


def bleu_mean(stats: DataFrame, batch_size: int, by: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """Plain mean of batch BLEU."""
    by = list(by or [])
    return batch_bleu(stats, batch_size, by, idx).groupBy(*by).agg(F.avg("bleu").alias("bleu_mean"))


def validation_bleu(
    stats: DataFrame, batch_size: int, fraction: float = 0.25, by: list[str] | None = None, idx: str = "idx"
) -> DataFrame:
    """Mean batch BLEU over the first ``int(n_batches * fraction)`` batches of each group."""
    user_by = list(by or [])
    by = user_by or ["_g"]
    src = stats if user_by else stats.withColumn("_g", F.lit(0))
    bb = batch_bleu(src, batch_size, by, idx)
    nb = bb.groupBy(*by).agg(F.count("*").alias("_nb"))
    keep = bb.join(nb, by).filter(F.col("batch_id") < F.floor(F.col("_nb").cast("double") * F.lit(float(fraction))))
    return keep.groupBy(*by).agg(F.avg("bleu").alias("val_bleu"), F.count("*").alias("n_batches")).drop(
        *([] if user_by else ["_g"])
    )
