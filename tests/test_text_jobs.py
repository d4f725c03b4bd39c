from transpark.operators import text_jobs as TJ


def test_reports_and_filters(spark):
    df = spark.createDataFrame(
        [("d", "test", "en", "  Hello world  "), ("d", "test", "en", "ok"), ("d", "dev", "de", " Guten  Tag ")],
        "dataset STRING, split STRING, lang STRING, text STRING",
    )
    out, rep = TJ.strip_lines(df, "text", out="clean", report_by=["dataset", "split", "lang"])
    assert sorted(r.clean for r in out.collect()) == ["Guten  Tag", "Hello world", "ok"]
    got = {(r.split, r.lang): (r.rows, r.changed, r.tokens) for r in rep.collect()}
    assert got == {("test", "en"): (2, 1, 3), ("dev", "de"): (1, 1, 2)}
    pairs = spark.createDataFrame([("a b", "c"), ("", "x"), ("a " * 300, "y")], "src STRING, tgt STRING")
    kept, drop_rep = TJ.drop_invalid_size(pairs, ("src", "tgt"), 1, 200, report=True)
    assert kept.count() == 1 and drop_rep.first().dropped == 2
    scored = TJ.score_diversity(TJ.add_word_counts(TJ.add_words(pairs, "src"), "src"), "src")
    r = scored.filter("tgt = 'c'").first()
    assert r.src_words == ["a", "b"] and r.src_n_words == 2 and r.src_n_unique == 2 and r.ttr == 1.0


def test_word_counter(spark):
    from collections import Counter

    from transpark.operators import text_jobs as J

    texts = ["a b a", "", None, "  ", "x", "b a　b\tA b", "w " * 5000 + "v"]
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, text STRING")
    rows = J.add_word_counter(df, "text").orderBy("k").collect()
    assert [r.text_counter for r in rows] == [None if t is None else dict(Counter(t.split())) for t in texts]
    got = {(r.k, r.word): r.n for r in J.word_counts(df, "text", ["k"]).collect()}
    assert got == {(k, w): n for k, t in enumerate(texts) for w, n in Counter((t or "").split()).items()}
    plan = J.add_word_counter(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_word_counter_of_many_words(spark):
    """The work on a text grows with its words, not with their square."""
    import time

    from transpark.operators import text_jobs as J

    n = 30_000
    text = " ".join(f"w{i % n}" for i in range(n + 7))
    df = spark.createDataFrame([(1, text)], "k INT, text STRING")
    start = time.monotonic()
    counts = {r.word: r.n for r in J.word_counts(df, "text", ["k"]).collect()}
    assert time.monotonic() - start < 20
    assert len(counts) == n and sorted(w for w, c in counts.items() if c == 2) == sorted(f"w{i}" for i in range(7))
