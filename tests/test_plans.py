"""Plan-shape checks for the properties the operators rely on at scale."""


from transpark.operators import bleu as B
from transpark.operators import select as S
from transpark.operators import vocab as V
from transpark.functions.text import words


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bleu_statistics_stay_in_their_row(spark):
    """No row is multiplied, nothing moves and no text n-gram is built; sums of groups are the one shuffle."""
    df = spark.createDataFrame([("r", 0, "a b", "a b")], "run STRING, idx LONG, hyp STRING, ref STRING")
    stats = B.segment_stats(df, keys=["run", "idx"])
    plan = _plan(stats)
    assert not any(x in plan for x in ("Exchange", "Generate", "Aggregate", "concat_ws"))
    assert _plan(B.corpus_bleu(stats, ["run"])).count("Exchange") == 1


def test_top_fraction_final_pass_is_map_only(spark):
    df = spark.createDataFrame([(i, "x " * (i % 7) + "y") for i in range(300)], "idx LONG, src STRING")
    plan = _plan(S.diversity_select(df, 0.5))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_lookup_uses_broadcast_and_one_shuffle(spark):
    df = spark.createDataFrame([(i, f"w{i % 13} w{i % 5}") for i in range(100)], "idx LONG, text STRING").withColumn("tok", words("text"))
    vocab = V.build_vocab(df, "tok")
    plan = _plan(V.encode_ids(df, "tok", vocab, key=["idx"]))
    assert "BroadcastHashJoin" in plan
    # ids are collected per row before the one exchange on the row key
    assert plan.count("Exchange hashpartitioning") == 1


def test_sizes_read_neither_text_nor_numbers(spark):
    from transpark.plans import catalog

    plan = _plan(catalog.QUERIES["dataset_sizes"](spark, "/root/testdata/sf0.001"))
    assert "text" not in plan.replace("input_file", "") and "Sort " not in plan
