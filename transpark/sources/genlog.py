"""Generation logs (S5, J4, T3): tagged tab-separated lines -> one row per sentence id.

``S-<id>\\t<source>``, ``T-<id>\\t<reference>``, ``H-<id>\\t<score>\\t<hypothesis>``;
lines with any other tag are dropped. The three tags are folded in one
conditional aggregation (one shuffle by id) instead of three passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (?s): a line may hold characters that a regex engine takes for line ends (U+0085, U+2028, ...)
LINE = r"(?s)^([STH])-([0-9]+)\t(.*)$"
HYP_BODY = r"(?s)^([^\t]*)\t(.*)$"


def parse_generation_log(
    df: DataFrame, col: str = "value", keys: list[str] | None = None, n_best: bool = False
) -> DataFrame:
    """``keys..., id LONG, src, ref, hyp STRING, score DOUBLE``; ``keys`` name the log a line
    came from (ids restart in every log). Of several hypotheses of an id, ``hyp`` and ``score``
    are those of the best-scored line (ties: the last text in order); ``n_best`` adds all of them,
    best first, as ``hyps ARRAY<STRUCT<score, hyp>>``."""
    keys = list(keys or [])
    tagged = df.select(
        *keys,
        F.regexp_extract(col, LINE, 1).alias("tag"),
        F.regexp_extract(col, LINE, 2).alias("id"),
        F.regexp_extract(col, LINE, 3).alias("body"),
    ).filter(F.col("tag") != "")
    tagged = tagged.withColumn("id", F.col("id").try_cast("long"))
    score, text = F.regexp_extract("body", HYP_BODY, 1).try_cast("double"), F.regexp_extract("body", HYP_BODY, 2)
    line = F.when(F.col("tag") == "H", F.struct(score.alias("score"), text.alias("hyp")))
    # the first of all hypotheses is the best one: it is not gathered a second time
    hyps = F.sort_array(F.collect_list(line), asc=False).alias("hyps") if n_best else F.max(line).alias("_best")
    folded = tagged.groupBy(*keys, "id").agg(
        F.max(F.when(F.col("tag") == "S", F.col("body"))).alias("src"),
        F.max(F.when(F.col("tag") == "T", F.col("body"))).alias("ref"),
        hyps,
    )
    if n_best:
        folded = folded.withColumn("_best", F.get("hyps", F.lit(0)))
    return folded.select(*keys, "id", "src", "ref", "_best.hyp", "_best.score", *(["hyps"] if n_best else []))


def read_generation_log(spark: SparkSession, path, n_best: bool = False) -> DataFrame:
    """Read log files and fold them per log (column ``log``: the file, or the folder whose
    ``part-*`` files Spark wrote); sort with ``natural_order`` only when exporting."""
    log = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[0-9]+[^/]*$", "")
    return parse_generation_log(spark.read.text(path).withColumn("log", log), keys=["log"], n_best=n_best)
