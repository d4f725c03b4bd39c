import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import EDGE, LONG, documents, edge_docs, no_docs

from transpark.llm import lexical_search as ls

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, k=10):
    """The contract's formula for every document and item."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, every = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, b, x in bags:
            m = 100 - 90 + 90 * x * n // every
            if score := sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if t in b):
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("block,passes,k", [(8192, 10**6, 10), (20, 10**6, 3), (50, 300, 1)])
def test_equals_brute_force(spark, monkeypatch, block, passes, k):
    """Any size of blocks and any number of passes over the items give the same rows."""
    monkeypatch.setattr(ls, "BLOCK_DOCS", block)
    monkeypatch.setattr(ls, "QUERY_TERMS", passes)
    docs = documents(spark).select("doc_id", "text").repartition(3)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert collected(ls.search(docs, items, k)) == brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"), k)


def test_edges(spark):
    """Nulls, empty and long texts, repeated documents, repeated and null items, clashing columns."""
    items = [(1, None), (2, ""), (3, "the same NINE words"), (3, "漢字 é text"), (None, "an id"), (4, "Word1 word2 nowhere"), (5, LONG)]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS block", "3 AS term")
    assert collected(ls.search(edge_docs(spark), asked)) == brute(EDGE, items)


def test_empty_tables(spark):
    nothing, item = no_docs(spark), spark.createDataFrame([(1, "a word")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a word"), (2, None)], "doc_id long, text string")
    assert ls.search(nothing, item).collect() == []
    assert ls.search(docs, item.limit(0)).collect() == []
    assert ls.search(docs, item.where("false").unionByName(spark.createDataFrame([(9, "--")], "item_id long, text string"))).collect() == []


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "common words of all") for i in (9, 3, None, 7, 3, 5)] + [(100 + i, f"other text {i}") for i in range(20)]
    items = [(1, "common words")]
    got = collected(ls.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5))
    assert got == brute(docs, items, 5)
    assert [r[2] for r in got] == [3, 3, 5, 7, 9]


def _blocks(spark, docs, items, k):
    """The bounded blocks of a search on the driver, with what it asks for."""
    scratch = ls.Scratch(spark, "test")
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(t.decode() for t in terms(t))
    names = sorted(set().union(*asked.values()))
    index = scratch.write(ls.postings(docs, names))
    n, every = (int(x) for x in index.selectExpr("sum(n_docs)", "sum(n_terms)").first())
    weights = np.zeros(len(names), np.int64)
    for r in ls.document_counts(index, len(names)).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    found = ls.Items.of({i: {names.index(t) for t in ts} for i, ts in asked.items()}, weights)
    batches = ls.with_bounds(index, found, weights, n, every).toArrow().to_batches()
    return [ls.Block(b, i, len(weights), len(found.pairs)) for b in batches for i in range(b.num_rows)], found, weights


def test_bounds_hold_and_pairs_tighten_them(spark, monkeypatch):
    """For any threshold a block gives exactly the documents at or above it, and with pairs it scores fewer
    postings than with the maxima of single terms."""
    monkeypatch.setattr(ls, "BLOCK_DOCS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    items = rows(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), "item_id", "text")[:12]
    blocks, found, weights = _blocks(spark, docs, items, 10)
    assert len(blocks) > 1
    skipped = {True: 0, False: 0}
    for block in blocks:
        for ts, pairs in zip(found.terms, found.pairs_of):
            full = np.zeros(len(block.ids), np.int64)
            for t in ts:
                if block.at[t] >= 0:
                    of = block.postings(block.at[t])
                    full[block.places[of]] += weights[t] * block.q[of]
            for p in pairs:
                if (x := block.pair_at[p]) >= 0:
                    a, b = (block.places[block.postings(block.at[t])] for t in found.pairs[p])
                    both = np.intersect1d(a, b)
                    assert sorted(block.pair_places[block.pair_starts[x] : block.pair_starts[x + 1]]) == both.tolist()
            top = np.sort(full)[::-1]
            for least in {1, int(top[min(10, len(top) - 1)]), int(top[0]), int(top[0]) + 1, int(top[len(top) // 2])} - {0}:
                for use in (True, False):
                    at, score = ls.search_block(block, ts, pairs if use else pairs[:0], found.pairs, weights, least)
                    want = np.flatnonzero(full >= least)
                    assert at.tolist() == want.tolist() and score.tolist() == full[want].tolist()
            most = sum(int(weights[t] * block.max_q[block.at[t]]) for t in ts if block.at[t] >= 0)
            for use in (True, False):
                low, high = 1, most + 1  # the least threshold at which the bounds alone rule out the whole block
                while low < high:
                    mid = (low + high) // 2
                    if _ruled_out(block, ts, pairs if use else pairs[:0], found, weights, mid):
                        high = mid
                    else:
                        low = mid + 1
                skipped[use] += low
    assert skipped[True] < 0.95 * skipped[False]


def _ruled_out(block, ts, pairs, found, weights, least):
    """Whether the bounds alone leave nothing to score: the block then looks at no posting."""
    seen = []

    class Watched(ls.Block):
        def __init__(self, other):
            self.__dict__.update(other.__dict__)

        def postings(self, x):
            seen.append(x)
            return super().postings(x)

    ls.search_block(Watched(block), ts, pairs, found.pairs, weights, least)
    return not seen


def test_long_documents_do_not_overflow():
    n = np.array([10, 3_000_000_000], np.int64)
    assert ls._normal_lengths(n, 50_000_000_000, 10**13).tolist() == [10 + 90 * 10 * 50_000_000_000 // 10**13, 10 + 90 * 3_000_000_000 * 50_000_000_000 // 10**13]
