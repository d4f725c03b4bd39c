"""Quality rules: fixed limits, then robust multivariate outliers for each language and source.

Fixed limits first: a document of fewer than ``LEAST_WORDS`` words fails, or one of whose words more than
``MOST_REPEATED`` in a hundred stand in 8-word windows that the text holds twice or more. The others have a vector
of transformed statistics (``STATISTICS``): roots of shares and logarithms, so that most documents of a group
lie about an ellipsoid. Centre and shape of each (lang, source) are the minimum-covariance-determinant estimate: the
mean and covariance of the ``COVERAGE`` share of rows whose covariance has the least determinant, scaled for
consistency. A small fixed variance (``FLOORS``) is added to each statistic, since many are zero in most
documents and an exact fit would reject all others. After the usual reweighting, a document goes whose squared
Mahalanobis distance exceeds the ``1 - TAIL`` quantile of the chi-squared distribution.

The estimate follows the nested scheme for large data: random starts and concentration steps on a
random subset of about ``START_ROWS`` rows of each group, the best ``STARTS`` of which go on over all rows.
Such a step over all rows is one aggregation: with integer vectors (1/``SCALE``) the moments are sums of whole
numbers by (group, start, bin of the distance), partial sums are made before the shuffle, and the bins up to the
coverage give the next estimate, whatever the order of rows. No group is ever gathered in one task.

A group of fewer than ``LEAST_ROWS`` rows joins the other small ones of its language, those of small
languages join each other; where even these are too few, the fixed limits alone decide. A null text counts as one
without words and fails; a null lang or source is a value like others. Repeated rows count as often as they
occur. An empty table gives an empty one. Columns but ``doc_id, text, lang, source`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import Scratch, map_batches, mix64, table, word_hashes
from transpark.operators.common import BROADCAST_BYTES, join_small

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: The vector, and the standard deviations added (in quadrature) to those of its members.
STATISTICS = ("ln n_words", "ln characters a word", "root of symbols a character", "root of punctuation a character", "root of capitals a character", "root of repeated lines' share", "root of repeated words' share")
FLOORS = (0.5, 0.05, 0.05, 0.05, 0.05, 0.25, 0.2)
SCALE = 1024
COVERAGE = 0.75
TAIL = 1e-4
LEAST_ROWS = 100  # of a group with an estimate of its own
START_ROWS = 1500  # of a group's random subset, about
SUBSETS = 60  # random starts on it
STARTS = 2  # that go on over all rows
STEPS = 8  # concentration steps over all rows at most
STILL = 1e-6  # relative change of the determinants that ends them
BINS = 16  # of the squared distance in a doubling

_D = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_X = [f"x{i}" for i in range(_D)]
_FLOOR = np.diag(np.square(FLOORS))
_SYMBOLS = "#*$%&|<>"
_CAPITAL = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, all occurrences included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            key = mix64(key + hashes[k : n + k])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def statistics(text: str) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the integer vector of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    inside = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero(inside & 0xC0 != 0x80))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(word_hashes(words))
    of = np.bincount(inside, minlength=256)
    c, w = max(chars, 1), max(n, 1)
    x = (
        math.log(w), math.log(c / w), math.sqrt(symbols / c), math.sqrt(of[_PUNCTUATION].sum() / c),
        math.sqrt(of[_CAPITAL].sum() / c), math.sqrt(dup / max(len(lines), 1)), math.sqrt(repeated / w),
    )
    return n, chars, symbols, dup, repeated, *(round(v * SCALE) for v in x)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts, ``base_failed`` and the vector of documents."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], np.int64)
        out = {k: batch.column(k) for k in ("doc_id", "lang", "source")}
        out |= {k: found[:, i] for i, k in enumerate(counts)}
        return out | {k: found[:, len(counts) + i].astype(np.int32) for i, k in enumerate(_X)}

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    schema = ["doc_id long", "lang string", "source string", *(f"{k} long" for k in counts), *(f"{k} int" for k in _X)]
    out = map_batches(docs.select(*columns), run, ", ".join(schema))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def chi2_cdf(x: float, d: int) -> float:
    """The chi-squared distribution of ``d`` (odd) degrees of freedom."""
    a, t = 0.5, x / 2
    p = math.erf(math.sqrt(t))
    while a < d / 2:
        p -= math.exp(a * math.log(t) - t - math.lgamma(a + 1)) if t > 0 else 0
        a += 1
    return p


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, d) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the innermost ``share`` of normal rows is multiplied by."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, _D), _D + 2)


def shape(n: int, total: list, products: list, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of ``n`` rows from the sums of their integers and products."""
    cov = np.zeros((_D, _D))
    for (i, j), s in zip(_PAIRS, products):  # whole numbers: the differences are exact
        cov[i, j] = cov[j, i] = (int(n) * int(s) - int(total[i]) * int(total[j])) / (int(n) * max(int(n) - 1, 1) * SCALE**2)
    return np.array([int(t) / (int(n) * SCALE) for t in total]), cov * consistency(share) + _FLOOR


def _moments(x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.int64)
    return shape(len(x), x.sum(0).tolist(), [int((x[:, i] * x[:, j]).sum()) for i, j in _PAIRS], share)


def _distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    y = x / SCALE - centre
    return np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov), y)


def starts(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best ``STARTS`` estimates of a subset's rows: two concentration steps from each of ``SUBSETS``
    random starts and one from the medians, then to the end for the best ten."""
    rng = np.random.default_rng(seed)
    h = max(_D + 1, math.ceil(COVERAGE * len(x)))
    share = h / len(x)

    def step(centre, cov):
        return _moments(x[np.argsort(_distances(x, centre, cov), kind="stable")[:h]], share)

    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0) / SCALE
    tried = [(middle / SCALE, np.diag(spread**2) + _FLOOR)]
    tried += [_moments(x[rng.choice(len(x), min(_D + 1, len(x)), replace=False)], 1.0) for _ in range(SUBSETS)]
    size = lambda e: np.linalg.slogdet(e[1])[1]
    tried = sorted((step(*step(*e)) for e in tried), key=size)[:10]
    done = []
    for e in tried:
        for _ in range(50):
            now = step(*e)
            if size(now) >= size(e) - 1e-12:
                break
            e = now
        done.append(e)
    done.sort(key=size)
    kept = done[:1]  # the best, and others that differ from it
    kept += [e for e in done[1:] if abs(size(e) - size(kept[0])) > 1e-9]
    return kept[:STARTS]


_ESTIMATE = "g long, start int, logdet double, centre array<double>, precision array<double>"


def _estimates(g: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    rows = []
    for i, (centre, cov) in enumerate(found):
        inverse = np.linalg.inv(cov)
        rows.append((g, i, float(np.linalg.slogdet(cov)[1]), centre.tolist(), [float(inverse[a, b]) * (1 if a == b else 2) for a, b in _PAIRS]))
    return pd.DataFrame(rows, columns=["g", "start", "logdet", "centre", "precision"])


def _first_estimates(vectors: DataFrame) -> DataFrame:
    """Estimates from a random subset of every group, chosen by a hash of the row's number."""
    share = F.lit(float(START_ROWS)) / F.col("rows")
    chance = F.shiftrightunsigned(F.xxhash64("_row"), 11).cast("double") / float(1 << 53)
    subset = vectors.where((F.col("rows") <= START_ROWS) | (chance < share))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        g = int(pdf["g"].iloc[0])
        return _estimates(g, starts(pdf[_X].to_numpy(np.int64), abs(g)))

    return subset.select("g", "_row", *_X).groupBy("g").applyInPandas(run, _ESTIMATE)


def _with_estimates(vectors: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the stored estimates of their group, which are of one size and broadcast while few."""
    few = estimates.count() * 8 * (4 + _D + len(_PAIRS)) <= BROADCAST_BYTES
    return vectors.join(F.broadcast(estimates) if few else estimates, "g", how)


def _distance() -> Column:
    """The squared distance of a row's vector from ``centre`` and ``precision``."""
    y = [F.col(x) / float(SCALE) - F.col("centre")[i] for i, x in enumerate(_X)]
    terms = [F.col("precision")[n] * y[i] * y[j] for n, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _sums() -> list[Column]:
    long = [F.col(x).cast("long") for x in _X]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(long)], *[F.sum(long[i] * long[j]).alias(f"p{n}") for n, (i, j) in enumerate(_PAIRS)]]


_S, _P = [f"s{i}" for i in range(_D)], [f"p{n}" for n in range(len(_PAIRS))]


def _concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step over all rows: moments by bin of the distance, then those of the innermost
    bins that hold the coverage."""
    bin_ = F.floor(F.lit(float(BINS)) * F.log2(F.greatest(F.col("d2"), F.lit(2.0**-20)))).cast("int")
    d2 = _with_estimates(vectors, estimates).select("g", "start", *_X, _distance().alias("d2"))
    binned = d2.groupBy("g", "start", bin_.alias("bin")).agg(*_sums())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, of in pdf.sort_values(["start", "bin"]).groupby("start"):
            n = of["n"].cumsum().to_numpy()
            last = int(np.searchsorted(n, math.ceil(COVERAGE * n[-1]))) + 1
            inner = of.iloc[:last]
            add = lambda cs: [sum(map(int, inner[c])) for c in cs]
            found.append(shape(int(n[last - 1]), add(_S), add(_P), n[last - 1] / n[-1]))
        return _estimates(int(pdf["g"].iloc[0]), found)

    return binned.groupBy("g").applyInPandas(run, _ESTIMATE)


def _reweighted(vectors: DataFrame, best: DataFrame) -> DataFrame:
    """The moments of all rows within the 97.5 % quantile of the best estimate."""
    near = _with_estimates(vectors, best).where(_distance() <= chi2_quantile(0.975, _D)).groupBy("g").agg(*_sums())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [_estimates(int(r["g"]), [shape(int(r["n"]), [r[c] for c in _S], [r[c] for c in _P], 0.975)]) for r in pdf.to_dict("records")]
            if made:
                yield pd.concat(made)

    return near.mapInPandas(run, _ESTIMATE)


def group_estimates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """``g, centre, precision`` from stored ``g, rows`` (of the group), ``_row`` (a number) and the vector."""
    vectors = vectors.select("g", "rows", "_row", *_X)
    now = scratch.write(_first_estimates(vectors), "estimates")
    for _ in range(STEPS):
        last, now = now, scratch.write(_concentrated(vectors, now), "estimates")
        change = last.select("g", "start", F.col("logdet").alias("before")).join(now, ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        if change is None or change <= STILL:
            break
    best = now.groupBy("g").agg(F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    best = scratch.write(best, "best")
    return scratch.write(_reweighted(vectors, best), "estimates").select("g", "centre", "precision")


def _grouped(stats: DataFrame) -> DataFrame:
    """``lang, source, g, rows``: the group that judges the rows of a language and source, and its size."""
    counts = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_ROWS
    of_lang = counts.where(small).groupBy("lang").agg(F.sum("n").alias("m"))
    others = of_lang.where(F.col("m") < LEAST_ROWS).agg(F.sum("m")).first()[0] or 0
    level = F.when(~small, 0).when(F.col("m") >= LEAST_ROWS, 1).otherwise(2)
    rows = F.when(level == 0, F.col("n")).when(level == 1, F.col("m")).otherwise(F.lit(others))
    of_lang = of_lang.select(F.col("lang").alias("_lang"), "m")
    every = counts.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    # JSON leaves out null fields, so that a null and the text "null" differ
    key = F.to_json(F.struct(level.alias("level"), F.when(level <= 1, F.col("lang")).alias("lang"), F.when(level == 0, F.col("source")).alias("source")))
    every = every.select("lang", "source", F.xxhash64(key).alias("g"), rows.cast("long").alias("rows"))
    return every.where(F.col("rows") >= LEAST_ROWS)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts, ``base_failed, distance`` (squared; null where no group judges)
    and ``kept`` of documents (``doc_id, text, lang, source``)."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.write(document_statistics(docs), "statistics")
    of = _grouped(stats).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "g", "rows")
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    stats = scratch.write(join_small(stats, of, same, "left").drop("_l", "_s").withColumn("_row", F.monotonically_increasing_id()), "grouped")
    estimates = group_estimates(stats.where(~F.col("base_failed") & F.col("g").isNotNull()), scratch)
    judged = _with_estimates(stats, estimates, "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= chi2_quantile(1 - TAIL, _D), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", "lang", "source", *counts, "base_failed", distance.alias("distance"), kept.alias("kept"))


def op11_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return judge(docs).select(*columns)
