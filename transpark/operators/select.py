"""Selection and ordering: top fraction by score (T1/T2), natural order (T3),
seeded shuffle (T4), consecutive batches (W1) and token-budget batches (W2).

Top fraction semantics (fixed by the reference): rank rows by score
descending, ties in input order (``idx`` ascending), keep the first
``int(N * fraction)`` rows. Blank rows have a NULL score and rank last.

The cut is found without sorting the corpus: a histogram over distinct scores
gives the cut score and the quota among its ties; then the ``idx`` of the
quota-th tied row is found by repeated bucket histograms over the idx range
(each pass divides the range by ``BUCKETS``). The scores are computed once, into
a narrow (group, idx, score) table that all of this reads; the final selection
is a plain filter on the original rows. ``idx`` must be unique within a group
(for a corpus whose splits number their lines anew: ``by=["split"]``); repeated
ones that would change the number of rows kept raise an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from transpark.functions.text import ttr
from transpark.operators.common import join_small
from transpark.operators.numbering import number_by_key, prefix_sum
from transpark.session import materialize

BUCKETS = 4096


def _frac_name(f: float) -> str:
    short = "%g" % (f * 100)
    return "sel_" + (short if abs(float(short) - f * 100) < 1e-9 else repr(f * 100)).replace(".", "_")


def _frac_names(fractions: list[float]) -> list[str]:
    names = [_frac_name(f) for f in fractions]
    if len(set(names)) < len(names):
        raise ValueError(f"fractions share a column name: {names}")
    return names


def fraction_cuts(
    df: DataFrame, score: str, fractions: list[float], idx: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """One row per (group, fraction): ``k``, ``s_cut`` (NULL when the cut lies among NULL scores),
    ``cut_null`` and ``idx_cut``. Rows selected = score > s_cut, or score = s_cut and idx <= idx_cut.
    Groups where ``k`` = 0 get no row."""
    user_by = list(by or [])
    by = user_by or ["_g"]
    narrow = df.select(*user_by, F.col(idx).alias("_i"), F.col(score).cast("double").alias("_s"))
    if not user_by:
        narrow = narrow.withColumn("_g", F.lit(0))
    fr = F.array(*[F.struct(F.lit(i).alias("_f"), F.lit(float(f)).alias("_fv")) for i, f in enumerate(fractions)])

    narrow = materialize(narrow, "scores")
    hist = narrow.groupBy(*by, "_s").agg(F.count("*").alias("_c"), F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    # running counts without a one-task window, however many distinct scores there are
    hist = prefix_sum(hist, [F.col("_s").desc_nulls_last()], "_c", partition_by=by, name="_cum")
    hist = join_small(hist, hist.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    cuts = (
        hist.withColumn("_fr", F.explode(fr))
        .select("*", "_fr._f", "_fr._fv")
        # int(N * f) in double arithmetic, as Python computes it
        .withColumn("_k", F.floor(F.col("_n").cast("double") * F.col("_fv")).cast("long"))
        .filter((F.col("_k") > 0) & (F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
        .select(
            *by,
            "_f",
            "_k",
            F.col("_s").alias("s_cut"),
            F.col("_s").isNull().alias("cut_null"),
            (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_q"),
            "_c",
            "_lo",
            "_hi",
        )
    )
    # quota covers all ties: the cut idx is the largest tied idx
    cuts = cuts.withColumn("idx_cut", F.when(F.col("_q") == F.col("_c"), F.col("_hi")).when(F.col("_q") == 1, F.col("_lo")))
    cuts = materialize(cuts, "cuts")

    keys = [*by, "_f"]
    ties_all = None
    while cuts.filter(F.col("idx_cut").isNull()).limit(1).count() > 0:
        open_ = cuts.filter(F.col("idx_cut").isNull()).withColumn(
            "_b", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(BUCKETS))).cast("long")
        )
        if ties_all is None:
            # only the rows tied at an unresolved cut are needed from here on: write them once
            t = join_small(narrow, open_.select(*by, "_f", "s_cut"), by)
            ties_all = materialize(t.filter(F.col("_s").eqNullSafe(F.col("s_cut"))).select(*keys, "_i"), "ties")
        ties = join_small(ties_all, open_.select(*keys, "_lo", "_hi", "_b"), keys)
        ties = ties.filter(F.col("_i").between(F.col("_lo"), F.col("_hi")))
        bh = ties.groupBy(*keys, ((F.col("_i") - F.col("_lo")) / F.col("_b")).cast("long").alias("_bk")).agg(
            F.count("*").alias("_bc"), F.min("_i").alias("_blo"), F.max("_i").alias("_bhi")
        )
        wb = Window.partitionBy(*keys).orderBy("_bk")
        bh = bh.withColumn("_bcum", F.sum("_bc").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
        step = (
            bh.join(open_.select(*keys, "_q"), keys)
            .filter((F.col("_bcum") >= F.col("_q")) & (F.col("_bcum") - F.col("_bc") < F.col("_q")))
            .select(
                *keys,
                (F.col("_q") - (F.col("_bcum") - F.col("_bc"))).alias("_nq"),
                "_bc",
                "_blo",
                "_bhi",
            )
        )
        nxt = (
            cuts.join(step, keys, "left")
            .withColumn("_q", F.coalesce("_nq", "_q"))
            .withColumn("_c", F.coalesce("_bc", "_c"))
            .withColumn("_lo", F.coalesce("_blo", "_lo"))
            .withColumn("_hi", F.coalesce("_bhi", "_hi"))
            .withColumn(
                "idx_cut",
                F.coalesce(
                    "idx_cut",
                    F.when(F.col("_q") == F.col("_c"), F.col("_hi")).when(F.col("_q") == 1, F.col("_lo")),
                    F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")),
                ),
            )
            .drop("_nq", "_bc", "_blo", "_bhi")
        )
        cuts = materialize(nxt, "cuts")
    kept = join_small(narrow, cuts.select(*keys, "s_cut", "cut_null", "idx_cut"), by)
    kept = kept.filter(_selected(F.col("_s"), F.col("_i"), F.col("s_cut"), F.col("cut_null"), F.col("idx_cut")))
    wrong = cuts.select(*keys, "_k").join(kept.groupBy(*keys).agg(F.count("*").alias("_kept")), keys, "left")
    if not wrong.filter(~F.col("_k").eqNullSafe(F.col("_kept"))).isEmpty():
        raise ValueError(f"{idx!r} repeats within a group: name what makes it unique in by=[...]")
    return cuts.select(*user_by, "_f", "_k", "s_cut", "cut_null", "idx_cut")


def _selected(score: Column, idx: Column, s_cut: Column, cut_null: Column, idx_cut: Column) -> Column:
    above = F.when(cut_null, score.isNotNull()).otherwise(score > s_cut)
    at = score.eqNullSafe(s_cut) & (idx <= idx_cut)
    return F.coalesce(above | at, F.lit(False))


def top_fraction_flags(
    df: DataFrame, score: str, fractions: list[float], idx: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """Add one boolean column per fraction (``sel_50`` for 0.5) marking the selected rows."""
    by = list(by or [])
    names = _frac_names(fractions)
    cuts = fraction_cuts(df, score, fractions, idx, by)
    if not by:
        got = {r["_f"]: r for r in cuts.collect()}  # at most len(fractions) rows
        out = df
        for i, name in enumerate(names):
            r = got.get(i)
            if r is None:
                out = out.withColumn(name, F.lit(False))
            else:
                out = out.withColumn(
                    name,
                    _selected(
                        F.col(score).cast("double"), F.col(idx), F.lit(r["s_cut"]).cast("double"),
                        F.lit(r["cut_null"]), F.lit(r["idx_cut"]).cast("long"),
                    ),
                )
        return out
    wide = cuts.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_f") == i, F.struct("s_cut", "cut_null", "idx_cut"))).alias(f"_cut{i}")
            for i in range(len(fractions))
        ]
    )
    out = join_small(df, wide, by, "left")
    for i, name in enumerate(names):
        c = F.col(f"_cut{i}")
        out = out.withColumn(
            name,
            F.when(c.isNull(), F.lit(False)).otherwise(
                _selected(F.col(score).cast("double"), F.col(idx), c["s_cut"], c["cut_null"], c["idx_cut"])
            ),
        )
    return out.drop(*[f"_cut{i}" for i in range(len(fractions))])


def top_fraction(df: DataFrame, score: str, fraction: float, idx: str = "idx", by: list[str] | None = None) -> DataFrame:
    name = _frac_name(fraction)
    return top_fraction_flags(df, score, [fraction], idx, by).filter(F.col(name)).drop(name)


def diversity_select(
    df: DataFrame, fraction: float = 0.5, score_col: str = "src", idx: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """Keep the ``int(N * fraction)`` pairs whose ``score_col`` has the highest type-token ratio
    (stable: ties keep ``idx`` order). Adds column ``ttr``; sort by ``ttr desc, idx`` only on export."""
    return top_fraction(df.withColumn("ttr", ttr(score_col)), "ttr", fraction, idx, by)


def diversity_sweep(
    df: DataFrame, fractions: list[float], score_col: str = "src", idx: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """One flag column per fraction from one scoring pass and shared histograms."""
    return top_fraction_flags(df.withColumn("ttr", ttr(score_col)), "ttr", fractions, idx, by)


def natural_order(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Numeric order of ids (``sort -V`` on a fixed tag): a range sort."""
    return df.orderBy(F.col(id_col).cast("long"))


def shuffle_rows(df: DataFrame, seed: int, idx: str = "idx") -> DataFrame:
    """T4: seeded shuffle that does not depend on partitioning (``rand(seed)`` does): rows in order of
    a digest of seed and ``idx``."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(idx).cast("string"))), F.col(idx))


def assign_batches(df: DataFrame, batch_size: int, idx: str = "idx", name: str = "batch_id") -> DataFrame:
    """Consecutive batches over a dense 0-based ``idx``; the last one may be short."""
    return df.withColumn(name, F.floor(F.col(idx) / F.lit(batch_size)).cast("long"))


def token_budget_batches(
    df: DataFrame,
    length_col: str,
    max_tokens: int,
    idx: str = "idx",
    bucket_width: int = 16,
    by: list[str] | None = None,
    over: str = "raise",
) -> DataFrame:
    """W2 in fixed buckets: batches of similar length holding at most ``max_tokens`` padded tokens.

    A row longer than ``max_tokens`` fits no batch: it raises an error, or with ``over="single"`` it is a
    batch of its own, over the budget. ``fill_token_budget`` makes fewer batches.

    Rows fall into length buckets of ``bucket_width``; inside a bucket they are
    ordered by (length, idx) and cut into runs of ``floor(max_tokens / bucket upper
    length)`` rows (at least one row per batch). The rank inside a bucket is a
    dense index over (bucket, length, idx), so a bucket holding most of the
    corpus is still spread over many tasks; only these columns are sorted.
    """
    by = list(by or [])
    if over == "raise":
        _refuse_long(df, length_col, max_tokens)
    b = df.withColumn("bucket", (F.greatest(F.col(length_col), F.lit(1)) - 1).cast("long") / F.lit(bucket_width))
    b = b.withColumn("bucket", F.floor("bucket").cast("long"))
    ranked = number_by_key(b, [length_col, idx], partition_by=[*by, "bucket"], name="_rank")
    cap = F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / ((F.col("bucket") + 1) * F.lit(bucket_width)))).cast("long")
    return ranked.withColumn("batch_in_bucket", F.floor(F.col("_rank") / cap).cast("long")).drop("_rank")


def _refuse_long(df: DataFrame, length_col: str, max_tokens: int) -> None:
    long = df.where(F.col(length_col) > max_tokens).agg(F.count("*"), F.max(length_col)).first()
    if long[0]:
        raise ValueError(f"{long[0]} rows are longer than {max_tokens} tokens, up to {long[1]}")


def fill_token_budget(
    df: DataFrame, length_col: str, max_tokens: int, idx: str = "idx", by: list[str] | None = None, name: str = "batch_id", over: str = "raise"
) -> DataFrame:
    """Batches filled one after the other in order of (length, ``idx``): a row joins the open batch as long as
    rows times longest row stay within ``max_tokens``, and opens the next one otherwise. ``name`` counts the
    batches of a group (``by``) from 0.

    Rows of one length are alike, so the filling is worked out on the counts of lengths, at most ``max_tokens``
    numbers for a group however many rows it has; a row finds its batch from its place among the rows of its length,
    which are numbered without gathering them. Null lengths and those below 1 count as 1. Rows longer than
    ``max_tokens`` raise an error, or with ``over="null"`` have no batch and are thus reported."""
    by = list(by or [])
    if over == "raise":
        _refuse_long(df, length_col, max_tokens)
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(1)), F.lit(1)).cast("long")
    rows = df.withColumn("_len", length)
    ranked = number_by_key(rows.where(F.col("_len") <= max_tokens), [idx], partition_by=[*by, "_len"], name="_rank")
    # a struct of the group as the key, so that null groups are groups
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("_"))
    counts = rows.where(F.col("_len") <= max_tokens).groupBy(F.to_json(key).alias("_group"), "_len").agg(F.count("*").alias("_n"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, held = [], 0, 0
        for group, size, n in sorted(pdf.itertuples(index=False), key=lambda r: r[1]):
            cap = max_tokens // size
            if held >= cap:  # the open batch has no room for a row of this length
                batch, held = batch + 1, 0
            out.append((group, size, batch, cap - held))
            full, held = divmod(held + n, cap)
            batch += full
            if held == 0:  # just filled: still the open one
                batch, held = batch - 1, cap
        return pd.DataFrame(out, columns=["_group", "_len", "_first", "_room"])

    fills = counts.groupBy("_group").applyInPandas(fill, "_group string, _len long, _first long, _room long")
    placed = join_small(ranked.withColumn("_group", F.to_json(key)), fills, ["_group", "_len"])
    later = F.col("_rank") - F.col("_room")
    batch = F.when(later < 0, F.col("_first")).otherwise(F.col("_first") + 1 + F.floor(later / F.floor(F.lit(max_tokens) / F.col("_len"))))
    placed = placed.withColumn(name, batch.cast("long")).select(*df.columns, name)
    if over == "raise":
        return placed
    return placed.unionByName(rows.where(F.col("_len") > max_tokens).withColumn(name, F.lit(None).cast("long")).select(*df.columns, name))
