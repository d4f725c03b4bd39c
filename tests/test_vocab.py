from collections import Counter

import pytest
from pyspark.sql import functions as F

from transpark.functions.text import words
from transpark.operators import common, numbering
from transpark.operators import vocab as V

TEXTS = ["the cat sat on the mat", "the dog", "a cat and a dog", "", "zebra"]


def _df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "idx LONG, text STRING").withColumn("tok", words("text"))


def test_build_vocab_order(spark):
    v = V.build_vocab(_df(spark), "tok").collect()
    counts = Counter(w for t in TEXTS for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    got = {r.token: (r.cnt, r.id) for r in v}
    for i, s in enumerate(V.SPECIALS):
        assert got[s][1] == i
    for i, w in enumerate(order):
        assert got[w] == (counts[w], i + 4)
    top = V.build_vocab(_df(spark), "tok", n=2)
    assert top.count() == 6


@pytest.mark.parametrize("broadcast_bytes,hot", [(32 << 20, 65_536), (0, 2)])
def test_encode_decode_round_trip(spark, monkeypatch, broadcast_bytes, hot):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast_bytes)  # 0: frequent entries broadcast, the rest joined
    monkeypatch.setattr(V, "HOT_ENTRIES", hot)
    df = _df(spark).unionByName(spark.createDataFrame([(9, None)], "idx LONG, text STRING").withColumn("tok", F.array().cast("array<string>")))
    vocab = V.build_vocab(df, "tok", n=4)
    known = {r.token: r.id for r in vocab.collect()}
    enc = V.encode_ids(df, "tok", vocab, ["idx"])
    assert enc.columns == ["idx", "text", "tok", "ids"]
    dec = V.decode_ids(enc, "ids", vocab, ["idx"], out="back").collect()
    assert len(dec) == len(TEXTS) + 1
    for r in dec:
        toks = (r.text or "").split()
        assert r.ids == [known.get(t, V.UNK) for t in toks]
        assert r.back == " ".join(t for t in toks if t in known)
    plain = V.decode_ids(enc, "ids", None, out="s").filter("idx = 1").first().s
    assert plain == " ".join(str(known.get(t, 3)) for t in "the dog".split() if known.get(t, 3) >= 4)
    with pytest.raises(ValueError):
        V.decode_ids(enc, "ids", vocab)


def test_lookup_plan(spark):
    """One exchange on the row key, no sort-merge join, no top-k."""
    vocab = V.build_vocab(_df(spark), "tok")
    plan = V.encode_ids(_df(spark), "tok", vocab, ["idx"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "TakeOrdered" not in plan


def test_decode_labels(spark):
    df = _df(spark)
    vocab = V.build_vocab(df, "tok")
    packed = V.pack_examples(V.encode_ids(df, "tok", vocab, ["idx"]), "ids", "ids", max_len=4).select("idx", "labels")
    assert {r.idx: r.text for r in V.decode_labels(packed, vocab, ["idx"]).collect()} == {i: " ".join(t.split()[:3]) for i, t in enumerate(TEXTS)}


def test_pack_pad_unmask(spark):
    df = spark.createDataFrame([(0, [5, 6, 7, 8, 9], [10, 11]), (1, [5], [])], "idx LONG, s ARRAY<INT>, t ARRAY<INT>")
    p = {r.idx: r for r in V.pack_examples(df, "s", "t", max_len=4).collect()}
    assert p[0].input_ids == [5, 6, 7, 2] and p[0].attention_mask == [1, 1, 1, 1] and p[0].labels == [10, 11, 2, -100]
    assert p[1].input_ids == [5, 2, 1, 1] and p[1].attention_mask == [1, 1, 0, 0] and p[1].labels == [2, -100, -100, -100]
    un = V.unmask_labels(V.pack_examples(df, "s", "t", max_len=4), "labels").filter("idx = 1").first().labels
    assert un == [2, 1, 1, 1]
    b = df.withColumn("batch", F.lit(0))
    padded = {r.idx: r.s for r in V.pad_to_batch_max(b, "s", "batch").collect()}
    assert padded[1] == [5, 1, 1, 1, 1]


def test_lookup_moves_ids_as_longs(spark):
    """Places and ids are one number an element, sorted as numbers; columns that nobody keeps do not travel."""
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"], "note"), (2, [], "n"), (3, None, None)], "k LONG, tok ARRAY<STRING>, note STRING")
    vocab = spark.createDataFrame([("a", 1, 4), ("b", 1, 2147483647)], "token STRING, cnt LONG, id INT")
    got = {r.k: r.ids for r in V.encode_ids(df, "tok", vocab, ["k"], unk=-7, keep=[]).collect()}
    assert got == {1: [2147483647, -7, 4, 2147483647], 2: [], 3: []}
    out = V.encode_ids(df, "tok", vocab, ["k"], keep=["note"])
    assert out.columns == ["k", "note", "ids"] and {r.k: r.note for r in out.collect()} == {1: "note", 2: "n", 3: None}
    assert "array_sort" not in V.encode_ids(df, "tok", vocab, ["k"], keep=[])._jdf.queryExecution().optimizedPlan().toString()


def _both_ways(monkeypatch, make):
    """The rows of ``make()`` with the whole vocabulary broadcast, and with two frequent entries apart from the rest."""
    whole = make().collect()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "HOT_ENTRIES", 2)
    apart = make()
    return sorted(map(str, whole)), sorted(map(str, apart.collect())), apart._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_elements_are_not_exploded(spark, monkeypatch):
    """With a large vocabulary only elements that are not among its frequent entries become rows; keys may repeat or be
    null, elements too."""
    rows = [(1, ["b", "x", None, "a", "c", "b"], "n"), (1, ["c", "a"], "n"), (None, ["a", "d"], "m"), (2, [], None), (3, None, "o"), (4, ["d", "a", "d"], "")]
    df = spark.createDataFrame(rows, "k LONG, tok ARRAY<STRING>, note STRING")
    vocab = spark.createDataFrame([("a", 9, 4), ("b", 5, 5), ("c", 2, 6), ("d", 1, 7), (None, 1, 8)], "token STRING, cnt LONG, id INT")
    whole, apart, plan = _both_ways(monkeypatch, lambda: V.encode_ids(df, "tok", vocab, ["k"], unk=-7))
    assert whole == apart and len(apart) == 5
    assert "posexplode" not in plan and "inline" in plan


def test_rare_and_repeated_entries_decode_alike(spark, monkeypatch):
    df = spark.createDataFrame([(1, [7, 4, 99, None, 6, 4]), (2, [5, 5]), (None, [6]), (3, None), (4, [99])], "k LONG, ids ARRAY<INT>")
    vocab = spark.createDataFrame([("a", 9, 4), ("b", 5, 5), ("bb", 5, 5), ("c", 2, 6), ("d", 1, 7)], "token STRING, cnt LONG, id INT")
    whole, apart, plan = _both_ways(monkeypatch, lambda: V.decode_ids(df, "ids", vocab, ["k"]).select("k", "text"))
    assert whole == apart and "text='d a c a'" in str(apart) and "text='b bb b bb'" in str(apart)
    assert "posexplode" not in plan


def test_vocab_counts_before_rows_are_made(spark, monkeypatch):
    """Tokens are counted batch by batch: what is grouped are sums of counts, not one row per token. Null tokens are one."""
    plans = []
    monkeypatch.setattr(V, "dense_index", lambda df, *a, **b: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or numbering.dense_index(df, *a, **b))
    df = spark.createDataFrame([(["b", "a", "b", None],), (["b", None],), ([],), (None,)], "tok ARRAY<STRING>")
    assert {r.token: r.cnt for r in V.build_vocab(df, "tok", specials=()).collect()} == {"a": 1, "b": 3, None: 2}
    assert "MapInArrow" in plans[0] and "explode" not in plans[0]


def test_words_cut_at_one_plain_character(spark):
    """``str.split()`` over every whitespace character, without a pattern tried at every place."""
    every = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    texts = [every, "".join(f"a{c}b{c}{c}" for c in every), " x​y é　\U0001f600 ", "", "one"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text STRING").select("text", words("text").alias("w"))
    assert [r.w for r in df.collect()] == [*(t.split() for t in texts), None]
    assert "split(translate(" in df._jdf.queryExecution().optimizedPlan().toString()
