import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from helpers import EDGE, documents, edge_docs, no_docs

from transpark.llm import importance as im

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    w = WORD.findall((text or "").encode().lower())
    return [b" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)


def brute(rows, target, percent=10, max_n=1, buckets=10000, min_words=20):
    of = lambda f: zlib.crc32(f) % buckets
    mine = [(d, *features(t, max_n)) for d, t in rows]
    s = Counter(of(f) for _, fs, _ in mine for f in fs)
    t = Counter(of(f) for x in target for f in features(x, max_n)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, fit = [], []
    for d, fs, n in mine:
        weight = sum(gain(of(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None])
        if n >= min_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("max_n,percent", [(1, 10), (3, 50)])
def test_equals_brute_force(spark, max_n, percent):
    docs = documents(spark).select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = collected(im.resample(docs, target, percent=percent, max_n=max_n, buckets=977))
    assert got == brute([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], percent, max_n, 977)


@pytest.mark.parametrize("max_n", [1, 2])
def test_edges(spark, max_n):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    target = spark.createDataFrame([(None,), ("",), ("one TWO two",), ("漢字 é",)], "text string")
    got = collected(im.resample(edge_docs(spark), target, percent=100, max_n=max_n, min_words=1))
    assert got == brute(EDGE, [None, "", "one TWO two", "漢字 é"], 100, max_n, min_words=1)


def test_empty_tables(spark):
    nothing = no_docs(spark)
    assert im.resample(nothing, nothing).collect() == []
    rows = [(1, "a b"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(im.resample(docs, nothing, percent=100, min_words=0)) == brute(rows, [], 100, min_words=0)


def test_repeated_rows_get_ranks_of_their_own(spark):
    rows = [(7, "same words here")] * 40 + [(None, "same words here")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(im.resample(docs, docs, percent=100, min_words=1))
    assert sorted(r[4] for r in got) == list(range(1, 44))


def test_words_of_a_slice():
    """A slice of a longer column has the words of its own rows."""
    column = pa.array(["x y", "A\x00b-Cé", None, "--", "Ünd 1a"]).slice(1, 4)
    vocabulary, codes, rows = im.split_words(column)
    assert [vocabulary[c].as_py() for c in codes.tolist()] == ["a", "b", "cé", "Ünd", "1a"]
    assert rows.tolist() == [0, 0, 0, 3, 3]
