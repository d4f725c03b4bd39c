"""Isolated pairs inside a dense group far wider than a window."""

import numpy as np

from transpark.llm.vector_dedup import near_duplicate_vectors


def test_pairs_in_a_dense_group(spark):
    rng = np.random.default_rng(3)
    n, pairs, size = 3000, 200, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(size))
    around = lambda k: unit((lambda u: u - (u @ centre)[:, None] * centre)(rng.standard_normal((k, size))))
    u = around(n)
    near = unit(0.775 * u[:pairs] + np.sqrt(1 - 0.775**2) * around(pairs))
    x = np.concatenate([np.sqrt(0.8) * centre + np.sqrt(0.2) * u, np.sqrt(0.8) * centre + np.sqrt(0.2) * near])
    x = unit(x)
    links = (x @ x.T) >= 0.95
    np.fill_diagonal(links, False)
    a, b = np.nonzero(np.triu(links))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.component_id for r in near_duplicate_vectors(df, passes=6, window=8).collect()}
    assert len(a) > 100 and np.mean([got[i] == got[j] for i, j in zip(a.tolist(), b.tolist())]) >= 0.99
