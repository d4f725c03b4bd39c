import random

from transpark.operators import runs as RN

# The published result matrix (model x test set x metric, mean and stdev), typed in.
RESULTS = [
    ("Baseline", "IT", 38.31, 5.7, 81.9, 14.5, "NEWS", 29.23, 7.7, 83.4, 7.7),
    ("FT w/ PARA", "IT", 38.92, 4.9, 82.5, 14.5, "NEWS", 28.6, 7.3, 82.7, 6.4),
    ("FT w/ BT", "IT", 41.83, 5.6, 84.0, 7.1, "NEWS", 27.11, 7.2, 82.0, 8.4),
    ("FT w/ PARA+BT", "IT", 39.88, 6.2, 86.12, 10.3, "NEWS", 26.66, 7.2, 82.2, 8.4),
    ("w/ 1 iter BT", "IT", 38.65, 6.9, 85.69, 13.2, "NEWS", 27.31, 7.2, 82.34, 8.2),
    ("w/ DeepL", "IT", 38.34, 6.7, 85.53, 13.3, "NEWS", 27.31, 7.2, 82.42, 8.1),
]


def _long(spark):
    rows = []
    for m, t1, b1, bs1, c1, cs1, t2, b2, bs2, c2, cs2 in RESULTS:
        rows += [(m, f"{t1}_BLEU", b1, bs1), (m, f"{t1}_COMET", c1, cs1), (m, f"{t2}_BLEU", b2, bs2), (m, f"{t2}_COMET", c2, cs2)]
    return spark.createDataFrame(rows, "model STRING, column STRING, mean DOUBLE, stdev DOUBLE")


def test_compare_and_best(spark):
    cols = ["IT_BLEU", "IT_COMET", "NEWS_BLEU", "NEWS_COMET"]
    table = {r.model: r for r in RN.compare_runs(_long(spark), cols).collect()}
    assert table["FT w/ BT"].IT_BLEU == 41.83 and table["Baseline"].NEWS_COMET == 83.4
    best = {(r.column, r.model) for r in RN.best_per_column(_long(spark)).collect() if r.is_best}
    assert best == {("IT_BLEU", "FT w/ BT"), ("IT_COMET", "FT w/ PARA+BT"), ("NEWS_BLEU", "Baseline"), ("NEWS_COMET", "Baseline")}


def _py_early_stop(values, patience):
    best, best_step, last = None, None, None
    for s, v in enumerate(values):
        if best is None or v > best:
            best, best_step, last = v, s, s
        if s - last >= patience:
            return s, best_step, best
    return None, best_step, best


def test_early_stop_and_best_checkpoint(spark):
    rnd = random.Random(5)
    runs = {f"r{k}": [round(rnd.random() + s * 0.001 * (k % 3), 3) for s in range(rnd.randint(5, 80))] for k in range(12)}
    rows = [(r, s, v) for r, vals in runs.items() for s, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run STRING, step LONG, value DOUBLE")
    got = {r.run: (r.stop_step, r.best_step, r.best_value) for r in RN.early_stop_point(df, 7, chunk=3).collect()}
    for run, vals in runs.items():
        assert got[run] == _py_early_stop(vals, 7), run
    best = {r.run: (r.best_step, r.best_value) for r in RN.best_checkpoint(df).collect()}
    for run, vals in runs.items():
        m = max(vals)
        assert best[run] == (vals.index(m), m)
    low = {r.run: r.best_value for r in RN.best_checkpoint(df, mode="min").collect()}
    assert all(low[k] == min(v) for k, v in runs.items())


def test_validations_lie_apart(spark):
    """Steps 0, 1000, 2000, ...: patience counts validations."""
    values = [0.1, 0.3, 0.2, 0.25, 0.31, 0.3, 0.3, 0.9]
    df = spark.createDataFrame([("r", 1000 * i * i, v) for i, v in enumerate(values)], "run STRING, step LONG, value DOUBLE")
    for chunk in (2, 100):
        assert [tuple(r) for r in RN.early_stop_point(df, 2, chunk=chunk).collect()] == [("r", 9000, 1000, 0.3)]
        assert [tuple(r) for r in RN.early_stop_point(df, 3, chunk=chunk).collect()] == [("r", None, 49000, 0.9)]
        assert [tuple(r) for r in RN.early_stop_point(df, 2, mode="min", chunk=chunk).collect()] == [("r", 4000, 0, 0.1)]


def test_best_checkpoints(spark):
    rnd = random.Random(9)
    rows = [(r, s, rnd.choice([None, 1.0, 2.0, 3.0, 4.0])) for r in ("a", "b", None) for s in range(300)] + [("few", 1, 0.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "run STRING, step LONG, value DOUBLE").repartition(5)
    for mode, sign in (("max", -1), ("min", 1)):
        got = {}
        for r in RN.best_checkpoints(df, 3, mode=mode, salts=4).collect():
            got.setdefault(r.run, {})[r["rank"]] = (r.step, r.value)
        want = {}
        for run in ("a", "b", None, "few"):
            best = sorted(((sign * v, s, v) for x, s, v in rows if x == run and v is not None))[:3]
            want[run] = {i + 1: (s, v) for i, (_, s, v) in enumerate(best)}
        assert got == want
