import random

import pytest
from pyspark.sql import functions as F

from transpark.operators import select as S
from transpark.operators.numbering import dense_index


def _python_select(rows, fraction):
    def ttr(s):
        w = s.split()
        return len(set(w)) / len(w) if w else None

    scored = [(ttr(s), i) for i, s in rows]
    # stable sort, descending score; blank lines (None) last
    order = sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
    return sorted(i for _, i in order[: int(len(order) * fraction)])


def _corpus(n, seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "d", "e"]
    rows = []
    for i in range(n):
        k = rnd.choice([0, 1, 2, 3, 4, 6])
        rows.append((i * 3 + rnd.randint(0, 2), " ".join(rnd.choice(vocab) for _ in range(k))))
    return rows


@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.3, 0.5, 0.7, 0.95, 1.0])
def test_top_fraction_matches_stable_sort(spark, fraction, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 4)  # force several refinement passes
    rows = _corpus(300, 7)
    df = spark.createDataFrame(rows, "idx LONG, src STRING")
    got = sorted(r.idx for r in S.diversity_select(df, fraction).select("idx").collect())
    assert got == _python_select(rows, fraction)


def test_top_fraction_by_group_and_partitioning(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 8)
    rows = _corpus(240, 11)
    data = [(i, s, "g%d" % (i % 3)) for i, s in rows]
    exp = []
    for g in ("g0", "g1", "g2"):
        exp += _python_select([(i, s) for i, s, gg in data if gg == g], 0.4)
    for parts in (1, 4, 24):
        df = spark.createDataFrame(data, "idx LONG, src STRING, grp STRING").repartition(parts)
        got = sorted(r.idx for r in S.diversity_select(df, 0.4, by=["grp"]).collect())
        assert got == sorted(exp)


def test_prefix_sum(spark):
    from transpark.operators.numbering import prefix_sum

    data = [(k % 4, k, (k * 7) % 11) for k in range(300)]
    df = spark.createDataFrame(data, "g INT, k INT, w INT").repartition(5)
    got = {r.k: r.cum for r in prefix_sum(df, [F.desc("k")], "w", partition_by=["g"], num_partitions=6).collect()}
    for g in range(4):
        run = 0
        for _, k, w in sorted((x for x in data if x[0] == g), key=lambda x: -x[1]):
            run += w
            assert got[k] == run


def test_continuous_scores(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, rnd.random(), 0.5, 0.25])) for i in range(500)]
    df = spark.createDataFrame(rows, "idx LONG, s DOUBLE")
    got = sorted(r.idx for r in S.top_fraction(df, "s", 0.6).collect())
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
    assert got == sorted(i for i, _ in order[: int(500 * 0.6)])


def test_sweep_flags(spark):
    rows = _corpus(120, 3)
    df = spark.createDataFrame(rows, "idx LONG, src STRING")
    out = S.diversity_sweep(df, [0.3, 0.5, 1.0]).collect()
    for f, name in ((0.3, "sel_30"), (0.5, "sel_50"), (1.0, "sel_100")):
        assert sorted(r.idx for r in out if r[name]) == _python_select(rows, f)


def test_repeated_line_numbers_and_close_fractions(spark):
    """Splits that number their lines anew: an error without the split, right per split."""
    rows = [(i, f"a b{i} " + "a " * (i % 3), s) for s in ("dev", "test", "train") for i in range(10)]
    df = spark.createDataFrame(rows, "idx LONG, src STRING, split STRING")
    with pytest.raises(ValueError, match="repeats"):
        S.diversity_select(df, 0.35)
    got = S.diversity_select(df, 0.35, by=["split"]).collect()
    assert sorted((r.split, r.idx) for r in got) == [(s, i) for s in ("dev", "test", "train") for i in _python_select([(i, t) for i, t, z in rows if z == s], 0.35)]
    one = df.filter("split = 'dev'")
    names = S.diversity_sweep(one, [0.3333331, 0.3333334]).columns
    assert len(set(names)) == len(names) == 6
    with pytest.raises(ValueError, match="share"):
        S.diversity_sweep(one, [0.5, 0.5])


def test_number_by_key(spark):
    from transpark.operators.numbering import number_by_key

    rows = [(i % 3, None if i == 4 else i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "g INT, k INT, t STRING").repartition(4)
    got = {r.t: r.n for r in number_by_key(df, ["k"], ["g"], "n").collect()}
    for g in range(3):
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [got[t] for _, _, t in members] == list(range(len(members)))
    with pytest.raises(ValueError):
        number_by_key(df.union(df), ["k"], ["g"], "n")


def test_mixing(spark):
    from transpark.operators.assembly import mix_corpora

    parts = {n: spark.createDataFrame([(i, f"{n}{i}") for i in range(k)], "idx LONG, src STRING").repartition(3) for n, k in (("a", 20), ("b", 7), ("c", 0))}
    want = [(f"a{i}", i) for i in range(20)] + [(f"b{i}", 20 + i) for i in range(7)]
    for dense in (False, True):
        out = mix_corpora(parts, dense=dense)
        assert sorted(((r.src, r.idx) for r in out.collect()), key=lambda x: x[1]) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan  # offsets alone


def test_dense_index_and_groups(spark):
    data = [(k % 5, (k * 7919) % 1000, k) for k in range(500)]
    df = spark.createDataFrame(data, "g INT, v INT, k INT").repartition(7)
    got = {r.k: r.idx for r in dense_index(df, ["v", "k"], partition_by=["g"], num_partitions=5).collect()}
    for g in range(5):
        members = sorted((v, k) for gg, v, k in data if gg == g)
        for pos, (_, k) in enumerate(members):
            assert got[k] == pos


def test_token_budget_batches(spark):
    lens = [(i, (i * 37) % 200 + 1) for i in range(300)]
    df = spark.createDataFrame(lens, "idx LONG, n LONG")
    out = S.token_budget_batches(df, "n", 1024, bucket_width=32).collect()
    for r in out:
        assert r.bucket == (r.n - 1) // 32
    by = {}
    for r in out:
        by.setdefault((r.bucket, r.batch_in_bucket), []).append(r)
    for (b, _), rs in by.items():
        assert len(rs) * (b + 1) * 32 <= max(1024, (b + 1) * 32)


def test_shuffle_is_partition_independent(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    a = [r.idx for r in S.shuffle_rows(df.repartition(1), 5).collect()]
    b = [r.idx for r in S.shuffle_rows(df.repartition(9), 5).collect()]
    assert a == b and sorted(a) == list(range(100)) and a != list(range(100))


def test_hot_group(spark, monkeypatch):
    """One group holds 90 % of the rows, nearly all tied: results stay exact."""
    monkeypatch.setattr(S, "BUCKETS", 16)
    rows = [(i, "a b c" if i % 10 else "a a b", "hot" if i % 10 else f"g{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "idx LONG, src STRING, grp STRING").repartition(6)
    got = sorted(r.idx for r in S.diversity_select(df, 0.25, by=["grp"]).collect())
    exp = []
    for g in sorted({r[2] for r in rows}):
        exp += _python_select([(i, s) for i, s, gg in rows if gg == g], 0.25)
    assert got == sorted(exp)
    numbered = {r.idx: r.n for r in dense_index(df, ["idx"], partition_by=["grp"], name="n", num_partitions=8).collect()}
    for g in sorted({r[2] for r in rows}):
        members = sorted(i for i, _, gg in rows if gg == g)
        assert [numbered[i] for i in members] == list(range(len(members)))


def _filled(rows, budget):
    """Greedy filling row by row."""
    out, batch, held = {}, 0, 0
    for idx, n in sorted(rows, key=lambda r: (max(r[1] or 1, 1), r[0])):
        n = max(n or 1, 1)
        if (held + 1) * n > budget:
            batch, held = batch + 1, 0
        out[idx], held = batch, held + 1
    return out


def test_token_budget_is_filled_exactly(spark):
    rnd = random.Random(2)
    groups = {
        "a": [(i, rnd.randint(0, 60)) for i in range(700)],
        "hot": [(i, 7) for i in range(2000)] + [(5000, 64), (5001, 64), (5002, None)],
        None: [(3, 64), (1, 1)],
        "b": [(0, 1)],
    }
    df = spark.createDataFrame([(g, i, n, "x") for g, rows in groups.items() for i, n in rows], "grp STRING, idx LONG, n LONG, k0 STRING").repartition(5)
    got = S.fill_token_budget(df, "n", 64, by=["grp"]).collect()
    assert got[0].asDict().keys() == {"grp", "idx", "n", "k0", "batch_id"}
    for g, rows in groups.items():
        assert {r.idx: r.batch_id for r in got if r.grp == g} == _filled(rows, 64)
    sizes = {}
    for r in got:
        sizes.setdefault((r.grp, r.batch_id), []).append(max(r.n or 1, 1))
    assert all(len(x) * max(x) <= 64 for x in sizes.values())
    only = df.where("grp = 'a'").drop("grp", "k0")
    wide = S.token_budget_batches(only, "n", 64, bucket_width=16).select("bucket", "batch_in_bucket").distinct().count()
    assert S.fill_token_budget(only, "n", 64).select("batch_id").distinct().count() < wide


def test_rows_over_the_budget_are_refused_or_reported(spark):
    df = spark.createDataFrame([(0, 5), (1, 100), (2, 5)], "idx LONG, n LONG")
    for fn in (S.fill_token_budget, S.token_budget_batches):
        with pytest.raises(ValueError, match="1 rows are longer than 64"):
            fn(df, "n", 64)
    assert {r.idx: r.batch_id for r in S.fill_token_budget(df, "n", 64, over="null").collect()} == {0: 0, 1: None, 2: 0}
    assert S.token_budget_batches(df, "n", 64, over="single").count() == 3
    assert S.fill_token_budget(df.limit(0), "n", 64).collect() == []
