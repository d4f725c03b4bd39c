from helpers import EDGE, documents, edge_docs, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from transpark.llm.line_dedup import canonical, chunks, dedup_lines, removable

PASSAGE = " ".join(f"Sentence {i} of a passage that many documents share with each other." for i in range(8))


def brute(rows):
    """The first occurrence by (doc_id, nulls last) stays; rows alike in id and text count once."""
    kept, first = {}, {}
    for doc_id, text in sorted({(d, t) for d, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0)):
        out = []
        for i, chunk in enumerate(chunks(text)):
            if not removable(chunk, canonical(chunk)) or first.setdefault(canonical(chunk), (doc_id, text, i)) == (doc_id, text, i):
                out += chunk
        kept[doc_id, text] = b"".join(out).decode()
    return sorted((str(d), kept.get((d, t), t) or "") for d, t in rows)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = dedup_lines(df).collect()
    assert sorted((str(r.doc_id), r.deduped or "") for r in got) == brute(rows)
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab. \n?!é")))
def test_chunks_are_the_text(text):
    assert b"".join(b"".join(c) for c in chunks(text)).decode() == text


def test_edge_rows(spark):
    got = check(edge_docs(spark))
    assert len(got) == len(EDGE) and next(r for r in got if r.doc_id == 1).deduped is None
    assert next(r for r in got if r.doc_id == 10).n_removed > 1000  # the long text again
    assert dedup_lines(no_docs(spark)).count() == 0


def test_documents(spark):
    got = check(documents(spark, "0.01"))
    assert sum(r.n_removed for r in got) > 0


def test_shared_passages_go_and_the_rest_stays(spark):
    rows = [(i, "\n".join([f"Opening {i} line one has its own words.", f"And a second {i * 7} one.", PASSAGE, f"Closing words {i} follow here."])) for i in range(30)]
    rows += [(100 + i, f"Nothing of this {i} text is shared. Not a {i} word of it, dear reader.") for i in range(5)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert PASSAGE in got[0].deduped
    for i in range(1, 30):
        assert "passage" not in got[i].deduped and f"Opening {i} line" in got[i].deduped and f"Closing words {i}" in got[i].deduped
    assert all(got[100 + i].n_removed == 0 and got[100 + i].deduped == rows[30 + i][1] for i in range(5))


def test_frequent_chunks_are_salted(spark, monkeypatch):
    from transpark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SALT_ROWS", 4)
    check(spark.createDataFrame([(i, PASSAGE + f"\nOwn {i}.") for i in range(50)], "doc_id long, text string"))
