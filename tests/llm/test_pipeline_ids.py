"""Near duplicates go whatever their ids: missing ones, and repeated ones with different texts."""

import corpus_pipeline as cp


def test_missing_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near = text + " more"
    other = " ".join(f"another{i}" for i in range(60))
    nulls = " ".join(f"unnamed{i}" for i in range(60))
    rows = [(1, text), (None, text), (None, near), (4, other), (4, near), (None, nulls), (None, nulls), (None, nulls + " x"), (None, "Too short."), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in cp.ngram_jaccard_join(spark, docs, "").collect()]
    assert len(got) == 5 and {(1, text), (4, other), (None, "Too short."), (7, None)} < set(got)
    assert sum(t is not None and t.startswith(nulls) for _, t in got) == 1
