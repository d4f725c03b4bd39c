import pytest

from transpark.operators import udf as U
from transpark.operators.runs import segment_score_summary


def test_translate_and_teacher(spark):
    df = spark.createDataFrame([(i, f"  w{i} & x <{i}>  ") for i in range(50)], "idx LONG, src STRING")
    out = {r.idx: r.hyp for r in U.translate_corpus(df, U.reverse_words_translator, batch_size=7).collect()}
    assert out[3] == "<3> x & w3"
    t = {r.idx: r.hyp for r in U.teacher_translate(df, U.escaping_reverse_translator, batch_size=7, max_parallel=3).collect()}
    assert t == out and len(t) == 50


def test_cardinality_check_and_retries(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "idx LONG, src STRING")

    def bad():
        return lambda texts: texts[:-1]

    with pytest.raises(Exception):
        U.translate_corpus(df, bad).collect()

    def flaky():
        state = {"n": 0}

        def fn(texts):
            state["n"] += 1
            if state["n"] == 1:
                raise RuntimeError("transient")
            return [t.upper() for t in texts]

        return fn

    got = sorted(r.hyp for r in U.translate_corpus(df, flaky, retries=2, backoff=0.0).collect())
    assert got == ["A", "B"]


def test_scores(spark):
    df = spark.createDataFrame([("s", "a b c", "a b d"), ("s", "x", "y")], "src STRING, hyp STRING, ref STRING")
    scored = U.score_segments(df, U.overlap_scorer)
    vals = sorted(r.seg_score for r in scored.collect())
    assert vals == [0.0, pytest.approx(2 / 3)]
    summ = segment_score_summary(scored).first()
    assert summ.score_mean == pytest.approx(100 * (2 / 3) / 2) and summ.segments == 2


def test_workers_keep_few_models(spark, tmp_path):
    """Twenty functions over the same workers: never more models than allowed, replaced ones are closed, and
    a function that comes again at once is not loaded again."""
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"w{i}") for i in range(40)], "idx LONG, src STRING").repartition(2)

    def maker(k):
        def make():
            import os

            from transpark.operators import udf

            class Model:
                def __call__(self, texts):
                    with open(f"{log}-{os.getpid()}", "a") as f:
                        f.write(f"held {len(udf._LOADED)}\n")
                    return [f"{k} {t}" for t in texts]

                def close(self):
                    with open(f"{log}-{os.getpid()}", "a") as f:
                        f.write(f"closed {k}\n")

            with open(f"{log}-{os.getpid()}", "a") as f:
                f.write(f"loaded {k}\n")
            return Model()

        return make

    for k in range(20):
        for _ in range(2):
            assert {r.hyp.split()[0] for r in U.translate_corpus(df, maker(k)).collect()} == {str(k)}
    closed = 0
    for path in tmp_path.iterdir():
        lines = path.read_text().splitlines()
        assert all(int(x.split()[1]) <= U.MODELS for x in lines if x.startswith("held"))
        names = [x for x in lines if x.startswith("loaded")]
        assert len(names) == len(set(names))
        closed += sum(x.startswith("closed") for x in lines)
        assert len(names) - sum(x.startswith("closed") for x in lines) <= U.MODELS
    assert closed > 0


def test_identity_of_functions():
    def maker(k):
        return lambda: lambda texts: [k] * len(texts)

    assert U.identity(maker(1)) == U.identity(maker(1)) != U.identity(maker(2))
    assert U.identity(U.reverse_words_translator) != U.identity(U.overlap_scorer)


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.createDataFrame([(0, "a b")], "idx LONG, src STRING")
    assert U.translate_corpus(df, U.reverse_words_translator).first().hyp == "b a" and spark.conf.get(key) == before


def test_few_rows_are_objects_at_a_time():
    """An Arrow batch is cut into slices of whole batches of the function."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"src": [str(i) for i in range(1000)]})
    sizes = [p.num_rows for p in U._slices([batch], 100)]
    assert sizes == [200] * 5 and sum(sizes) == 1000
    assert [p.num_rows for p in U._slices([batch, batch], 700)] == [700, 300, 700, 300]
    assert [p.num_rows for p in U._slices([batch], 32)] == [256, 256, 256, 232]


def test_other_columns_stay(spark):
    """Integers with nulls, dates and arrays pass as they are."""
    df = spark.sql("SELECT * FROM VALUES (1L, 'a b', array(1, NULL)), (NULL, NULL, NULL) AS t(k, src, xs)")
    got = sorted(tuple(r) for r in U.translate_corpus(df, U.reverse_words_translator).select("hyp", "k", "xs", "src").collect())
    assert got == [("", None, None, None), ("b a", 1, [1, None], "a b")]
