import hashlib

import numpy as np
from helpers import EDGE, documents, edge_docs, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transpark.llm.fingerprint import _above, digests, document_fingerprints, half_edited, likeness, sketch


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df, rows):
    """Against sets, in the order (doc_id descending, nulls last, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = half_edited(text, after)
        sets = [digests(t) for t in (text, edited, after)]
        want.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2])))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in document_fingerprints(df).collect()]
    assert sorted(got) == sorted(want)


def test_edge_rows(spark):
    check(edge_docs(spark).repartition(3), EDGE)
    prints = {r.doc_id: r.fingerprint for r in document_fingerprints(edge_docs(spark)).collect()}
    assert prints[5] == prints[6] != prints[8] and prints[1] == prints[2]
    assert document_fingerprints(no_docs(spark)).count() == 0
    check(edge_docs(spark, [(4, "One. Two.")]), [(4, "One. Two.")])


def test_documents(spark):
    df = documents(spark)
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_bounds(spark):
    for bounds in ([], [7], [9, 4, 1], list(range(100, 0, -3))):
        got = spark.range(-3, 110).select("id", _above(F.col("id"), bounds)).collect()
        assert [r[1] for r in got] == [sum(b > v for b in bounds) for v in range(-3, 110)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1))), max_size=4))
def test_peeling_recovers_differences(pairs):
    left = [np.array(sorted(a | c), np.uint64) for a, _, c in pairs]
    right = [np.array(sorted(b | c), np.uint64) for _, b, c in pairs]
    assert np.allclose(likeness(left, right), [jaccard(a, b) for a, b in zip(left, right)])


def test_large_difference_retries():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)) for _ in range(2))
    assert likeness([a, a], [b, a]).tolist() == [0.0, 1.0]
    assert all(np.array_equal(x, y) for x, y in zip(sketch(a), sketch(a[::-1])))
