import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from helpers import EDGE, documents, edge_docs, no_docs
from pyspark.sql import functions as F

from transpark.llm.common import fold_of
from transpark.llm.katz_lm import TOP, Discount, Model, katz_scores


def brute(rows, order):
    """Scores by recursion over dictionaries of n-grams of words, and the probability function."""
    tokens = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 or i is None]
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for t in train:
        w = ["<s>"] * (order - 1) + tokens(t)
        for p in range(order - 1, len(w)):
            for k in range(order):
                grams[k][tuple(w[p - k : p + 1])] += 1
                contexts[k][tuple(w[p - k : p])] += 1
    levels = []
    for g in grams:
        of = Counter(min(c, TOP + 2) for c in g.values())
        levels.append(np.array([of[r] for r in range(1, TOP + 3)] + [sum(g.values())]))
    model = Model(levels, len(train))
    d = lambda k, c: float(model.discounts[k].discounted(np.array([c]))[0])
    after = [defaultdict(list) for _ in range(order)]
    for k in range(1, order):
        for g in grams[k]:
            after[k][g[:-1]].append(g[-1])

    @cache
    def alpha(k, h):
        return (1 - sum(p(k, h, w) for w in after[k][h])) / (1 - sum(p(k - 1, h[1:], w) for w in after[k][h]))

    def p(k, h, w):
        c = grams[k][(*h, w)]
        if k == 0:
            return d(0, c) / model.tokens if c else model.unknown
        if c:
            return d(k, c) / contexts[k][h]
        return (alpha(k, h) if contexts[k][h] else 1) * p(k - 1, h[1:], w)

    out = []
    for i, t in rows:
        w = ["<s>"] * (order - 1) + tokens(t)
        at = range(order - 1, len(w))
        known = [grams[0][(w[x],)] for x in at]
        base = sum(math.log10((c + 1) / (model.tokens + model.distinct + 1)) for c in known)
        out.append((i, len(at), sum(c > 0 for c in known), model.tokens, base, sum(math.log10(p(order - 1, tuple(w[x - order + 1 : x]), w[x])) for x in at)))
    return out, p, list(grams[0]), list(contexts[-1])


def check(df, order, rows):
    held_out = F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False))
    got = katz_scores(df, ~held_out, order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want, *rest = brute(rows, order)
    for r, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:4] == w[:4] and r[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-6)
    return rest


@pytest.mark.parametrize("order", [1, 2, 3])
def test_documents(spark, order):
    df = documents(spark).repartition(4)
    p, vocabulary, contexts = check(df, order, [(r.doc_id, r.text) for r in df.collect()])
    for h in contexts[:: max(1, len(contexts) // 5)]:  # every context's distribution is whole
        assert sum(p(order - 1, h, w[0]) for w in vocabulary) + p(order - 1, h, "an unknown word") == pytest.approx(1, abs=1e-9)


def test_edge_rows(spark):
    check(edge_docs(spark).repartition(3), 2, EDGE)
    assert katz_scores(no_docs(spark), F.lit(True)).count() == 0
    untrained = katz_scores(edge_docs(spark), F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in untrained} == {(0, 0, 0.0)}


def test_discounts():
    d = Discount(np.array([1000, 400, 200, 120, 80, 60, 500, 9999]))
    taken = sum(n * r * (1 - x) for n, r, x in zip([1000, 400, 200, 120, 80], range(1, 6), d.d)) + 560 * d.off
    assert d.free == pytest.approx(taken) and (0 < d.d).all() and (d.d < 1).all() and d.off > 0
    assert (Discount(np.zeros(8)).d == 1 - 0.5 / np.arange(1, 6)).all()


def test_beats_the_base_on_held_out_texts(spark):
    from transpark.llm.queries import QUERIES

    rows = QUERIES["op8_katz_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.95
