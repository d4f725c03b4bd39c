"""Dataset assembly (M1-M3, A8): mixing real and synthetic pairs, role swap,
re-using the evaluation splits of a base dataset, split sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transpark.operators.numbering import number_by_key


def mix_corpora(parts: dict[str, DataFrame], idx: str = "idx", new_idx: str = "idx", dense: bool = False) -> DataFrame:
    """M1: bag union of several pair sets with an ``origin`` column and a new dense index
    in (part order, old index) order. All parts must share column names.

    With ``dense`` every part's ``idx`` is already 0..n-1, and the new index is an offset per
    part (no shuffle); otherwise only keys are numbered and joined back to the rows, so that
    text never goes through the range sort. A repeated ``idx`` in a part raises an error."""
    union, before = None, 0
    for order, (name, part) in enumerate(parts.items()):
        p = part.withColumn("origin", F.lit(name)).withColumn("_o", F.lit(order)).withColumnRenamed(idx, "_old")
        if dense:
            p = p.withColumn("_new", F.col("_old") + F.lit(before))
            before += part.count()
        union = p if union is None else union.unionByName(p)
    if not dense:
        union = number_by_key(union, ["_o", "_old"], name="_new")
    return union.drop("_o").withColumnRenamed("_old", "orig_idx").withColumnRenamed("_new", new_idx)


def swap_roles(df: DataFrame, hyp: str = "hyp", src: str = "src") -> DataFrame:
    """M2: the translation becomes the new source and the old source the new target."""
    rest = [c for c in df.columns if c not in (hyp, src, "tgt")]
    return df.select(*rest, F.col(hyp).alias("src"), F.col(src).alias("tgt"))


def with_eval_splits(train: DataFrame, base: DataFrame, split: str = "split") -> DataFrame:
    """M3: new training rows plus the non-training splits of the base dataset."""
    t = train if split in train.columns else train.withColumn(split, F.lit("train"))
    return t.unionByName(base.filter(F.col(split) != "train"), allowMissingColumns=True)


def dataset_sizes(df: DataFrame, by=("dataset", "split")) -> DataFrame:
    """Rows per dataset and split."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"))
