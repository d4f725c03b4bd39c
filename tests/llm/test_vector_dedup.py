import numpy as np

from transpark.llm.components import forest
from transpark.llm.vector_dedup import near_duplicate_vectors


def brute(ids, x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T) >= threshold
    np.fill_diagonal(links, False)
    u, v = forest(*(ids[k] for k in np.nonzero(links))) if links.any() else ([], [])
    comp = dict(zip(ids.tolist(), ids.tolist())) | dict(zip(np.asarray(u).tolist(), np.asarray(v).tolist()))
    return {i: (int(n), comp[i]) for i, n in zip(ids.tolist(), links.sum(1))}


def test_dense_groups_and_copies(spark):
    """Groups wider than a window and than a block: recall against brute force."""
    rng = np.random.default_rng(7)
    parts = [c + 0.2 * rng.standard_normal((k, 16)) * np.linalg.norm(c) / 4 for c, k in zip(rng.standard_normal((8, 16)), (150, 90, 60, 40, 20, 5, 3, 2))]
    x = np.concatenate([*parts, rng.standard_normal((300, 16))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:3], 40, 0)])
    ids = np.arange(len(x)) * 3 - 50
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(5)
    want = brute(ids, x.astype(np.float64))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, window=16, block=64).collect()}
    assert len(got) == len(x) and all(k == (i == c) for i, (_, c, k) in got.items())
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][:2] == want[i] for i in want]) > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, id string, component string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).where("vec_id is not null").collect())
    assert got == [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)] + [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (11, 0, 11, True)]
    alone = near_duplicate_vectors(df).where("vec_id is null").first()
    assert (alone.n_links, alone.component_id, alone.kept) == (0, None, False)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_documents_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.99


def by_rows(rows, threshold=0.95):
    """Links between ids over all pairs of rows."""
    near = {i: set() for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            if i != j and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                near[i].add(j)
    component = {i: i for i in near}
    for _ in near:
        component = {i: min([component[i], *(component[j] for j in near[i])]) for i in near}
    return sorted((i, len(near[i]), component[i], component[i] == i) for i, _ in rows)


def test_ids_on_several_vectors(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rng = np.random.default_rng(5)
    many = [(int(rng.integers(60)), (c + 0.15 * rng.standard_normal(3)).tolist()) for c in rng.standard_normal((30, 3)) for _ in range(4)]
    for rows in ([(3, a), (7, a), (7, b), (9, b)], [(20, a), (20, a)], [(5, a), (5, b)], [(5, a), (5, b), (5, a), (6, b), (1, b)], many):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert sorted(map(tuple, near_duplicate_vectors(df, passes=8, block=16).collect())) == by_rows(rows), rows


def test_double_precision(spark):
    """Components beyond 32 bits, very large and very small ones."""
    edge = 0.95 / np.sqrt(1 - 0.95**2)  # cosine with (1, 0) is 0.95
    rows = [(1, [1e300, 0.0]), (2, [2e300, 0.0]), (3, [1e-310, 0.0]), (4, [0.0, 1e-60]), (5, [float(edge * (1 + 1e-9)), -1.0]), (6, [float(edge * (1 - 1e-9)), -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 4, 1), (6, 1, 1)]
