from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, edge_docs, no_docs

from transpark.llm import ngram_join as nj


def exact_sets(rows):
    """Shingles as tuples of words, without hashes."""
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(rows):
    sets = exact_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j][1]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    name = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            name[find(i)] = min(doc_id, name.get(find(i), doc_id))
    return sorted((d, len(s), name.get(find(i)) if s else d) for i, (d, s) in enumerate(sets) if d is not None)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = nj.ngram_components(df).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_edge_rows(spark):
    check(edge_docs(spark))
    assert nj.ngram_components(edge_docs(spark)).where("doc_id is null").first().component_id is None
    assert nj.ngram_components(no_docs(spark)).count() == 0


def test_documents(spark):
    check(documents(spark, "0.01"))


def near_copies(n_groups, size, words=120, edits=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = [f"w{g}x{i}" for i in rng.integers(0, 4000, words)]
        for c in range(size):
            text = list(base)
            for at in rng.integers(0, words, edits):
                text[at] = f"e{g}_{c}_{at}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("hot, chunk", [(8192, 4096), (3, 16)])
def test_near_copies_in_large_groups_and_in_split_blocks(spark, monkeypatch, hot, chunk):
    """Groups of near copies around the threshold; with small limits, as hot shingles and split blocks."""
    monkeypatch.setattr(nj, "HOT", hot)
    monkeypatch.setattr(nj, "CHUNK", chunk)
    rows = near_copies(3, 60) + [(1000 + i, t) for i, t in near_copies(2, 40, edits=5, seed=2)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_points():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 600, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2)
        for t in (s, np.unique(s >> np.uint64(12))):  # spread out, and crowded in one group
            bits = int(nj.level(np.array([len(t)]))[0])
            want = np.bincount((t >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            assert np.array_equal(nj.unpacked(nj.point(t), 1 << bits), want)


def test_trees_lose_nothing():
    rng = np.random.default_rng(5)
    texts = [t for _, t in near_copies(20, 12, words=200, edits=6)]
    texts += [" ".join(f"r{x}" for x in rng.integers(0, 10**6, rng.integers(5, 400))) for _ in range(200)]
    sets = [nj.shingles(t) for t in texts]
    n = np.array([len(s) for s in sets])
    rows = {"sid": np.arange(len(sets)), "n": n, "small": np.ones(len(sets), bool), "comp": np.arange(len(sets)), "side": np.zeros(len(sets), np.int64)}
    block = nj.Block(rows, [nj.point(s) for s in sets])
    got = {(min(a, b), max(a, b)) for i, j, _ in block.joined(False) for a, b in zip(i.tolist(), j.tolist())}
    links = {(a, b) for a in range(len(sets)) for b in range(a) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (n[a] + n[b])}
    assert {(b, a) for a, b in links} <= got and len(got) < 0.2 * len(sets) ** 2 / 2


def test_no_scan_of_pairs(spark):
    plan = nj.ngram_components(documents(spark))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
