"""Results over many runs (A7, A9-A12): learned segment-score summary,
model x (test set, metric) table, best per column, best checkpoint per run,
early-stopping point per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transpark.operators.common import join_small
from transpark.operators.numbering import dense_index

CHUNK = 1 << 16  # windows hold at most CHUNK rows, the carry table rows/CHUNK per run


def segment_score_summary(scored: DataFrame, col: str = "seg_score", by=None, scale: float = 100.0) -> DataFrame:
    """Mean and sample stdev of a segment score per group, scaled (x100 like the reference's print)."""
    by = list(by or [])
    return scored.groupBy(*by).agg(
        (F.avg(col) * F.lit(scale)).alias("score_mean"),
        (F.stddev_samp(col) * F.lit(scale)).alias("score_std"),
        F.count("*").alias("segments"),
    )


def compare_runs(scores: DataFrame, columns: list[str], model="model", column="column", value="mean") -> DataFrame:
    """Long scores -> one row per model, one column per fixed (test set, metric) name."""
    return scores.groupBy(model).pivot(column, columns).agg(F.max(value))


def best_per_column(scores: DataFrame, column="column", value="mean") -> DataFrame:
    """A10: flag the best value of every column. The per-column maximum is a
    partial aggregation (hot columns do not gather in one task)."""
    best = scores.groupBy(column).agg(F.max(value).alias("_best"))
    out = join_small(scores, best, [column])
    return out.withColumn("is_best", F.col(value) == F.col("_best")).drop("_best")


def best_checkpoint(metrics: DataFrame, run="run", step="step", value="value", mode: str = "max") -> DataFrame:
    """Per run the step with the best value; ties go to the earliest step."""
    if mode == "max":
        best = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s")))
        return metrics.groupBy(run).agg(best.alias("_b")).select(
            run, (-F.col("_b.s")).alias("best_step"), F.col("_b.v").alias("best_value")
        )
    best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
    return metrics.groupBy(run).agg(best.alias("_b")).select(run, F.col("_b.s").alias("best_step"), F.col("_b.v").alias("best_value"))


def best_checkpoints(
    metrics: DataFrame, k: int, run="run", step="step", value="value", mode: str = "max", salts: int = 64
) -> DataFrame:
    """``run, rank, step, value`` of the ``k`` best steps of every run, ties to earlier steps; null values
    are no candidates. Steps are dealt into ``salts`` parts of their run, of which the k best remain, so that the last
    choice sees at most ``k * salts`` rows of a run; Spark keeps k rows before either shuffle."""
    order = [(F.desc if mode == "max" else F.asc)("_v"), F.asc("_s")]
    m = metrics.where(F.col(value).isNotNull()).select(F.col(run).alias("_r"), F.col(step).alias("_s"), F.col(value).alias("_v"))
    m = m.withColumn("_salt", F.pmod(F.xxhash64("_s"), F.lit(salts)))
    part = m.withColumn("rank", F.row_number().over(Window.partitionBy("_r", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("_r").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("_r").alias(run), "rank", F.col("_s").alias(step), F.col("_v").alias(value))


def early_stop_point(
    metrics: DataFrame, patience: int, run="run", step="step", value="value", mode: str = "max", chunk: int = CHUNK
) -> DataFrame:
    """First validation at which ``patience`` validations passed without a strict improvement.

    Validations are counted per run in order of ``step``, whatever the distance between steps. Runs are cut
    into chunks of ``chunk`` validations (default 65,536): windows run per (run, chunk), and what comes from
    earlier chunks (best so far, last improving validation) is carried by a small
    per-chunk table, so a very long run is still spread over many tasks.
    Output: ``run, stop_step`` (NULL if never), ``best_step, best_value`` at that point
    (or at the end of the run). A step given twice counts twice, in order of value.
    """
    sign = 1.0 if mode == "max" else -1.0
    m = metrics.select(F.col(run).alias("_r"), F.col(step).alias("_step"), (F.col(value) * F.lit(sign)).alias("_v"))
    m = dense_index(m, ["_step", "_v"], partition_by=["_r"], name="_n").withColumn("_c", F.floor(F.col("_n") / F.lit(chunk)).cast("long"))
    out = _stop_of_validations(m, patience)
    return out.select(F.col("_r").alias(run), "stop_step", "best_step", (F.col("best_value") * F.lit(sign)).alias("best_value"))


def _stop_of_validations(m: DataFrame, patience: int) -> DataFrame:
    """``_r, stop_step, best_step, best_value`` of ``_r, _n`` (validation), ``_c`` (chunk), ``_step, _v``."""
    run, step = "_r", "_n"
    chunks = m.groupBy(run, "_c").agg(F.max("_v").alias("_cmax"))
    wc = Window.partitionBy(run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_prev", F.max("_cmax").over(wc))
    rows = join_small(m, chunks.select(run, "_c", "_prev"), [run, "_c"])
    wr = Window.partitionBy(run, "_c").orderBy(step)
    before = F.greatest(F.col("_prev"), F.max("_v").over(wr.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_before", before).withColumn(
        "_imp", F.col("_before").isNull() | (F.col("_v") > F.col("_before"))
    )
    rows = rows.withColumn(
        "_last_in", F.last(F.when(F.col("_imp"), F.col(step)), ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, 0))
    )
    last_imp = rows.groupBy(run, "_c").agg(F.max(F.when(F.col("_imp"), F.col(step))).alias("_cl"))
    last_imp = last_imp.withColumn("_carry", F.max("_cl").over(wc))
    rows = join_small(rows, last_imp.select(run, "_c", "_carry"), [run, "_c"])
    rows = rows.withColumn("_last", F.coalesce("_last_in", "_carry")).withColumn("_wait", F.col(step) - F.col("_last"))
    stops = rows.groupBy(run).agg(F.min(F.when(F.col("_wait") >= patience, F.col(step))).alias("stop_step"))
    with_stop = join_small(m, stops, [run]).filter(F.col("stop_step").isNull() | (F.col(step) <= F.col("stop_step")))
    return with_stop.groupBy(run).agg(
        F.max(F.when(F.col(step) == F.col("stop_step"), F.col("_step"))).alias("stop_step"),
        F.max_by("_step", F.struct(F.col("_v"), -F.col(step))).alias("best_step"),
        F.max("_v").alias("best_value"),
    )
