"""Corpus text jobs (P1-P3, P7-P13) as DataFrame -> DataFrame functions.

Each job can also return a per-group report (rows, changed rows, tokens)
computed in the same pass with a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transpark.functions import rules as R
from transpark.functions import text as T
from transpark.session import materialize


def add_words(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unicode-whitespace tokens."""
    return df.withColumn(out or f"{col}_words", T.words(col))


def add_word_counts(df: DataFrame, col: str) -> DataFrame:
    """Total and distinct word counts."""
    w = T.words(col)
    return df.withColumn(f"{col}_n_words", F.size(w).cast("long")).withColumn(
        f"{col}_n_unique", F.size(F.array_distinct(w)).cast("long")
    )


def add_word_counter(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """The words of a row with their numbers, as a map; nothing is exploded or shuffled."""
    return df.withColumn(out or f"{col}_counter", T.word_counter(col))


def word_counts(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """P2 exploded: ``keys..., word, n``, a row for each distinct word of a row."""
    return df.select(*keys, F.explode(T.word_counter(col)).alias("word", "n"))


def score_diversity(df: DataFrame, col: str = "src", out: str = "ttr") -> DataFrame:
    """Type-token ratio (NULL for blank text)."""
    return df.withColumn(out, T.ttr(col))


def drop_invalid_size(
    df: DataFrame, cols=("src", "tgt"), min_len: int = 1, max_len: int = 1024, report: bool = False
):
    """Keep rows whose every side has between ``min_len`` and ``max_len`` words."""
    ok = F.lit(True)
    for c in cols:
        n = F.size(T.words(c))
        ok = ok & n.between(min_len, max_len)
    if not report:
        return df.filter(ok)
    # rows and report come from one pass: the flagged rows are written once
    flagged = materialize(df.withColumn("_ok", ok), "sized")
    rep = flagged.agg(F.count("*").alias("rows"), F.sum(F.when(~F.col("_ok"), 1).otherwise(0)).cast("long").alias("dropped"))
    return flagged.filter("_ok").drop("_ok"), rep


def _text_job(df: DataFrame, col: str, expr, out: str | None, report_by: list[str] | None):
    """The column ``out`` (default: ``col`` itself); with ``report_by`` also rows, changed rows and tokens
    per group, from one pass that writes the result."""
    target = out or col
    if report_by is None:
        return df.withColumn(target, expr)
    flagged = df.withColumn("_new", expr)
    flagged = flagged.withColumn("_changed", ~F.col(col).eqNullSafe(F.col("_new"))).withColumn("_tokens", F.size(T.words("_new")))
    rest = [c for c in df.columns if c != target]
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(report_by)]
    flagged = materialize(flagged.select(*rest, *keys, F.col("_new").alias(target), "_changed", "_tokens"), "job")
    rep = flagged.groupBy(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(report_by)]).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("_changed").cast("int")).cast("long").alias("changed"),
        F.sum("_tokens").cast("long").alias("tokens"),
    )
    return flagged.select(*rest, target), rep


def normalize_corpus(df: DataFrame, col: str = "text", out: str | None = None, report_by=None, lang: str | None = "en"):
    """Punctuation normalisation and control-character removal; quotes and punctuation in the order of
    ``lang`` (None: as they are)."""
    return _text_job(df, col, R.normalize(col, lang), out, report_by)


def tokenize_corpus(
    df: DataFrame, col: str = "text", out: str | None = None, dash_split=True, escape=True, report_by=None, lang: str = "en"
):
    """Rule tokenisation with optional aggressive hyphen split and XML escaping."""
    return _text_job(df, col, R.tokenize(col, dash_split, escape, lang), out, report_by)


def detokenize_corpus(df: DataFrame, col: str = "text", out: str | None = None, report_by=None):
    """P10: tokens back to plain text."""
    return _text_job(df, col, R.detokenize(col), out, report_by)


def join_pieces_corpus(df: DataFrame, col: str = "pieces", out: str | None = None, report_by=None):
    """Sentencepiece pieces back to words."""
    return _text_job(df, col, T.join_pieces(col), out, report_by)


def unescape_corpus(df: DataFrame, col: str = "text", out: str | None = None, report_by=None):
    """HTML character references back to characters."""
    return _text_job(df, col, T.unescape(col), out, report_by)


def strip_lines(df: DataFrame, col: str = "text", out: str | None = None, report_by=None):
    """Strip Unicode whitespace at both ends."""
    return _text_job(df, col, T.strip(col), out, report_by)
