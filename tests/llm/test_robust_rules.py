import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, LONG, documents, edge_docs, no_docs

from transpark.llm import robust_rules as rr

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_counts(text):
    """The contract's counts, window by window as tuples of words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_counts_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = {r["doc_id"]: r for r in rr.document_statistics(docs).collect()}
    for r in docs.collect():
        want = brute_counts(r["text"])
        assert tuple(got[r["doc_id"]][c] for c in COUNTS) == want
        assert got[r["doc_id"]]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize("text", ["a " * 9, "a b c d e f g h " * 2, "x\n\nx\n \n \nx", "é漢 < > # é漢", "a b c d e f g h i a b c d e f g h", "\x1c \x85  ", LONG])
def test_counts_of_single_texts(text):
    assert rr.statistics(text)[:5] == brute_counts(text)


def test_chi_squared():
    for p, d, x in ((0.975, 7, 16.0128), (0.5, 7, 6.3458), (0.95, 9, 16.9190), (0.9999, 7, 29.8775)):
        assert rr.chi2_quantile(p, d) == pytest.approx(x, abs=1e-3)


def _sample(n, outliers, seed=5):
    """Rows about one centre, and outliers about a second, tighter one."""
    rng = np.random.default_rng(seed)
    centre = np.array([5.0, 1.6, 0.1, 0.2, 0.15, 0.3, 0.2])
    mix = rng.normal(size=(7, 7)) * 0.3
    good = centre + rng.normal(size=(n, 7)) @ mix
    bad = centre + 9 + rng.normal(size=(outliers, 7)) * 0.1
    return np.rint(np.concatenate([good, bad]) * rr.SCALE).astype(np.int64), centre, mix.T @ mix + rr._FLOOR


def test_a_quarter_of_outliers_does_not_move_the_estimate():
    x, centre, cov = _sample(900, 290)
    e = rr.starts(x, 1)[0]
    assert np.abs(e[0] - centre).max() < 0.15
    assert np.abs(np.log(np.linalg.eigvalsh(np.linalg.solve(cov, e[1])))).max() < 0.5
    d = rr._distances(x, *e)
    assert (d[900:] > rr.chi2_quantile(1 - rr.TAIL, 7)).all() and (d[:900] <= rr.chi2_quantile(1 - rr.TAIL, 7)).mean() > 0.99


def brute_estimate(x, seed):
    """The estimate of a group whose rows are all in the subset, on one machine."""

    def step(e):
        d = np.maximum(rr._distances(x, *e), 2.0**-20)
        bins = np.floor(rr.BINS * np.log2(d))
        ordered = np.sort(bins)
        inner = bins <= ordered[math.ceil(rr.COVERAGE * len(x)) - 1]
        return rr._moments(x[inner], inner.mean())

    det = lambda e: np.linalg.slogdet(e[1])[1]
    now = rr.starts(x, seed)
    for _ in range(rr.STEPS):
        last, now = now, [step(e) for e in now]
        if max(abs(det(a) - det(b)) for a, b in zip(last, now)) <= rr.STILL:
            break
    best = min(now, key=det)
    return rr._moments(x[rr._distances(x, *best) <= rr.chi2_quantile(0.975, 7)], 0.975)


def test_distributed_estimates_equal_those_of_one_machine(spark, monkeypatch):
    """Two groups, one of them spread over all partitions with most of the rows."""
    groups = {1: _sample(1000, 200)[0], 2: _sample(150, 30, seed=8)[0]}
    rows = [(g, len(x), g * 10_000 + i, *map(int, v)) for g, x in groups.items() for i, v in enumerate(x)]
    random.Random(3).shuffle(rows)
    schema = "g long, rows long, _row long, " + ", ".join(f"{c} int" for c in rr._X)
    scratch = rr.Scratch(spark, "test")
    vectors = scratch.write(spark.createDataFrame(rows, schema).repartition(7))
    got = {r["g"]: r for r in rr.group_estimates(vectors, scratch).collect()}
    for g, x in groups.items():
        centre, cov = brute_estimate(x, g)
        inverse = np.linalg.inv(cov)
        assert np.allclose(got[g]["centre"], centre, rtol=1e-9)
        assert np.allclose(got[g]["precision"], [inverse[i, j] * (1 if i == j else 2) for i, j in rr._PAIRS], rtol=1e-6, atol=1e-9)


def test_subset_of_a_large_group_leads_to_the_same_estimate(spark, monkeypatch):
    x, centre, cov = _sample(4000, 1200)
    rows = [(1, len(x), i, *map(int, v)) for i, v in enumerate(x)]
    monkeypatch.setattr(rr, "START_ROWS", 300)
    scratch = rr.Scratch(spark, "test")
    vectors = scratch.write(spark.createDataFrame(rows, "g long, rows long, _row long, " + ", ".join(f"{c} int" for c in rr._X)))
    got = rr.group_estimates(vectors, scratch).first()
    assert np.allclose(got["centre"], brute_estimate(x, 1)[0], atol=0.01)


def test_held_out_quality(spark):
    """No label is an input: documents of low quality go, those of high quality stay unless fixed limits reject them."""
    sf = "/root/testdata/sf0.01"
    out = rr.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good[~good.base_failed].kept.mean() >= 0.99
    assert bad.kept.mean() <= 0.1
    assert not out[out.base_failed].kept.any()


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns; too few rows for an estimate."""
    df = edge_docs(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang", "'s' AS source", "1 AS x0", "2 AS rows", "3 AS distance")
    got = sorted((tuple(r[c] for c in ("doc_id", *COUNTS)), r["kept"], r["distance"]) for r in rr.judge(df).fillna(-99, ["doc_id"]).collect())
    want = sorted(((-99 if d is None else d, *brute_counts(t)), not (brute_counts(t)[0] < 20 or 100 * brute_counts(t)[4] > 30 * brute_counts(t)[0]), None) for d, t in EDGE)
    assert got == want
    assert rr.judge(no_docs(spark)).collect() == []


def test_small_groups_join_each_other(spark, monkeypatch):
    monkeypatch.setattr(rr, "LEAST_ROWS", 30)
    rows = [("en", "a", 40), ("en", "b", 20), ("en", "c", 15), ("de", "a", 10), (None, "a", 15), ("fr", None, 12), ("null", "a", 35), ("es", "a", 31)]
    docs = spark.createDataFrame([(lang, source, False) for lang, source, n in rows for _ in range(n)], "lang string, source string, base_failed boolean")
    got = {(r["lang"], r["source"]): (r["g"], r["rows"]) for r in rr._grouped(docs).collect()}
    assert got["en", "a"][1] == 40 and got["es", "a"][1] == 31 and got["null", "a"][1] == 35
    assert got["en", "b"] == got["en", "c"] and got["en", "b"][1] == 35
    assert got["de", "a"] == got[None, "a"] == got["fr", None] and got["de", "a"][1] == 37
    assert len({g for g, _ in got.values()}) == 5


def test_repeated_and_equal_rows_have_an_estimate(spark):
    """A group of one text only: no spread but the fixed one, nothing is rejected."""
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i // 2, text, "en", "s") for i in range(300)] + [(1000, text.upper().replace(" ", " ## "), "en", "s")], "doc_id long, text string, lang string, source string")
    out = rr.judge(docs).toPandas()
    assert out[out.doc_id < 1000].kept.all() and len(out) == 301
    assert not out[out.doc_id == 1000].kept.any()
