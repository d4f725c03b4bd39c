import os

import pytest


from transpark.operators import udf as U
from transpark.plans import workflows as WF


def _base(spark):
    rows = [(i, f"src {i}", f"tgt {i}", s) for i, s in enumerate(["train", "train", "dev", "test"])]
    return spark.createDataFrame(rows, "idx LONG, src STRING, tgt STRING, split STRING")


def test_back_translate(spark):
    mono = spark.createDataFrame([(i, f"w{i} v{i} u{i}") for i in range(10)], "idx LONG, text STRING")
    out = WF.back_translate(mono, U.reverse_words_translator, base=_base(spark))
    rows = out.collect()
    train = {r.idx: r for r in rows if r.split == "train"}
    assert len(train) == 10 and train[2].src == "u2 v2 w2" and train[2].tgt == "w2 v2 u2"
    assert sorted(r.split for r in rows if r.split != "train") == ["dev", "test"]
    mixed = WF.back_translate(mono, U.reverse_words_translator, base=_base(spark), mix_with_base=True, select_fraction=0.5)
    counts = {(r.split, r.origin): r["count"] for r in mixed.groupBy("split", "origin").count().collect()}
    assert counts[("train", "real")] == 2 and counts[("train", "synthetic")] == 5


def test_iterate_and_evaluate(spark):
    mono = spark.createDataFrame([(i, f"a{i} b c d e f{i} g") for i in range(20)], "idx LONG, text STRING")
    dev = spark.createDataFrame([(i, f"x y z w v u {i}", f"x y z w v u {i}") for i in range(40)], "idx LONG, src STRING, tgt STRING")
    seen = []

    def first_words(r, previous):
        """Round r's model keeps as many words as the data of the round before had in a row, and one more."""
        n = 4 if previous is None else 1 + max(len(x.src.split()) for x in previous.filter("direction = 'bt'").collect())
        seen.append((r, previous is None, n))
        make = lambda: (lambda texts: [" ".join(t.split()[:n]) for t in texts])
        return make, make

    datasets, scores = WF.iterate_back_translation(mono, mono, first_words, dev, rounds=9, stop_eps=0.5)
    assert seen == [(0, True, 4), (1, False, 5), (2, False, 6), (3, False, 7), (4, False, 8)]
    assert not datasets[0].exceptAll(datasets[1]).isEmpty() and datasets[0].count() == 40
    assert len(scores) == len(datasets) == 5 and scores[-1] == pytest.approx(100.0)  # rows have seven words: no gain any more
    assert all(b - a >= 0.5 for a, b in zip(scores[:-2], scores[1:-1]))
    segs = spark.createDataFrame(
        [(r, i, "s", f"a b c {i}", f"a b c {i}" if r == "good" else "a b") for r in ("good", "bad") for i in range(64)],
        "run STRING, idx LONG, src STRING, ref STRING, hyp STRING",
    )
    res = WF.evaluate_runs(segs, 32)
    table = {r.model: r for r in res["table"].collect()}
    assert table["good"].test_bleu == pytest.approx(100.0) and table["bad"].test_bleu < 100.0
    best = {r.column: r.model for r in res["best"].collect() if r.is_best}
    assert best == {"test_bleu": "good", "test_bleu_b32": "good"}


@pytest.mark.parametrize("fraction", [None, 0.5])
@pytest.mark.parametrize("mix", [False, True])
def test_the_model_sees_every_row_once(spark, tmp_path, fraction, mix):
    """Counted in files: what a worker loads once outlives the accumulators of a task."""
    folder = str(tmp_path)

    def note(kind, n):
        import os
        import uuid

        with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write(str(n))

    def total(kind):
        return sum(int(p.read_text()) for p in tmp_path.glob(f"{kind}-*"))

    def make():
        note("load", 1)

        def fn(texts):
            note("call", len(texts))
            return [t.upper() for t in texts]

        return fn

    mono = spark.createDataFrame([(i, f"w{i} v{i % 7} v{i % 3}") for i in range(60)], "idx LONG, text STRING").repartition(12)
    out = WF.back_translate(mono, make, base=_base(spark), select_fraction=fraction, mix_with_base=mix)
    assert out.count() > 0 and out.filter("split = 'train'").count() == (30 if fraction else 60) + (2 if mix else 0)
    assert total("call") == 60 and 1 <= total("load") <= spark.sparkContext.defaultParallelism


def test_evaluation_with_a_scorer_and_a_log(spark, tmp_path):
    segs = spark.createDataFrame(
        [(r, i, "s", f"a b c {i}", f"a b c {i}" if r == "good" else None) for r in ("good", "bad") for i in range(40)],
        "run STRING, idx LONG, src STRING, ref STRING, hyp STRING",
    )
    res = WF.evaluate_runs(segs, 32, make_scorer=U.overlap_scorer, log_path=str(tmp_path / "log"))
    log = {(r.model, r.metric): r.mean for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log["good", "score"] == pytest.approx(100.0) and log["bad", "score"] == 0.0 and len(log) == 6
    assert {r.run: r.ref_len for r in res["corpus"].collect()} == {"good": 160, "bad": 160}  # null hypotheses count


def test_a_scorer_does_not_read_the_segments_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    segs = spark.createDataFrame([("r", i, "s", f"a b c d {i}", f"a b c d {i}") for i in range(40)], "run STRING, idx LONG, src STRING, ref STRING, hyp STRING")
    res = WF.evaluate_runs(segs.mapInArrow(count, segs.schema), 32, make_scorer=U.overlap_scorer)
    assert {r.metric: r["mean"] for r in res["scores"].collect()} == pytest.approx({"bleu": 100.0, "bleu_b32": 100.0, "score": 100.0})
    assert seen.value == 40 and "seg_score" not in res["stats"].columns


def test_prepare_corpus(spark):
    df = spark.createDataFrame([(0, "Hello, world — it's “fine”.", "Hallo Welt."), (1, "A-B test", "A-B Test")], "idx LONG, src STRING, tgt STRING")
    out, vocab = WF.prepare_corpus(df)
    r = out.filter("idx = 1").first()
    assert r.src_tok == "A @-@ B test"
    assert len(r.src_ids) == 4 and all(i >= 4 for i in r.src_ids)
    assert set(vocab) == {"src", "tgt"}


def test_a_loop_goes_on_where_it_stopped(spark, tmp_path):
    """Stopped after round 1: a second start calls no function for rounds 0 and 1, and writes an unfinished round anew."""
    mono = spark.createDataFrame([(i, f"w{i} x y z") for i in range(20)], "idx LONG, text STRING")
    dev = spark.createDataFrame([(i, f"a b c d e{i}", f"e{i} d c b a") for i in range(8)], "idx LONG, src STRING, tgt STRING")
    log, asked = tmp_path / "calls", []
    log.mkdir()

    def calls():
        return sum(int(n) for f in log.iterdir() for n in f.read_text().split())

    def make_fns(stop_at):
        def fns(r, previous):
            asked.append((r, None if previous is None else previous.count()))
            if r == stop_at:
                raise RuntimeError("driver lost")

            def make():
                def fn(texts):
                    with open(f"{log}/{os.getpid()}", "a") as f:
                        f.write(f"{len(texts)}\n")
                    return [" ".join([str(r), *reversed(t.split())]) for t in texts]

                return fn

            return make, make

        return fns

    path = str(tmp_path / "loop")
    whole, scores = WF.iterate_back_translation(mono, mono, make_fns(None), dev, 3, stop_eps=None)
    with pytest.raises(RuntimeError):
        WF.iterate_back_translation(mono, mono, make_fns(2), dev, 3, stop_eps=None, path=path)
    spark.range(1).write.parquet(f"{path}/round2")  # data without a manifest: not finished
    before, asked[:] = calls(), []
    again, found = WF.iterate_back_translation(mono, mono, make_fns(None), dev, 3, stop_eps=None, path=path)
    assert asked == [(2, 40)] and calls() - before == 48 and found == scores
    for a, b in zip(whole, again):
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    before = calls()
    WF.iterate_back_translation(mono, mono, make_fns(0), dev, 3, stop_eps=None, path=path)
    assert calls() == before
    with pytest.raises(ValueError):
        WF.iterate_back_translation(mono, mono, make_fns(0), dev, 3, batch_size=7, stop_eps=None, path=path)


def test_a_round_has_one_copy_of_its_translations(spark, monkeypatch):
    from transpark.operators import udf as U
    from transpark.plans import workflows as WF

    written, plain = [], WF.materialize
    monkeypatch.setattr(WF, "materialize", lambda df, name="part", *a: written.append(name) or plain(df, name, *a))
    mono = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(40)], "idx LONG, text STRING")
    dev = spark.createDataFrame([(i, "a b c d e", "e d c b a") for i in range(40)], "idx LONG, src STRING, tgt STRING")
    fns = lambda r, previous: (U.reverse_words_translator, U.reverse_words_translator)
    datasets, _ = WF.iterate_back_translation(mono, mono, fns, dev, rounds=2, stop_eps=None)
    assert written == ["round0", "round1"]
    assert [d.count() for d in datasets] == [80, 80]


def _made_by(r):
    """Models that leave out every third word (forward) and every fourth one (backward)."""
    drop = lambda k: lambda: (lambda texts: [" ".join(w for i, w in enumerate(t.split()) if i % k != k - 1) for t in texts])
    return drop(3 + r), drop(4 + r)


def test_a_round_stores_a_text_and_its_translations_together(spark):
    """Both sides translate the same texts: rounds take little more than the texts once, not copies and translations of each."""
    import random

    rnd = random.Random(1)
    rows = [(i, " ".join(f"{rnd.getrandbits(48):x}" for _ in range(200))) for i in range(300)]
    mono = spark.createDataFrame(rows, "idx LONG, text STRING").coalesce(1)
    dev = spark.createDataFrame([(i, "a b c d e", "e d c b a") for i in range(8)], "idx LONG, src STRING, tgt STRING")
    datasets, _ = WF.iterate_back_translation(mono, mono, lambda r, _: _made_by(r), dev, 2, stop_eps=None)
    files = {f for d in datasets for f in d.inputFiles()}
    stored = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in files)
    text = sum(len(t) for _, t in rows)
    assert stored < 1.3 * text  # four translations; hexadecimal digits alone are half their text, a copy of them as much again


@pytest.mark.parametrize("same", [True, False])
def test_rounds_hold_the_pairs_of_both_sides(spark, same):
    """Repeated and null keys and null texts are rows like others, whether both sides are one corpus or two."""
    tgt = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j"), (None, "k l m n"), (2, None)], "idx LONG, text STRING")
    src = tgt if same else spark.createDataFrame([(7, "p q r s t u"), (7, None)], "idx LONG, text STRING")
    dev = spark.createDataFrame([(i, "a b c d e", "e d c b a") for i in range(8)], "idx LONG, src STRING, tgt STRING")
    datasets, _ = WF.iterate_back_translation(src, tgt, lambda r, _: _made_by(r), dev, 2, stop_eps=None)
    for r, data in enumerate(datasets):
        assert data.columns == ["idx", "src", "tgt", "split", "direction"]
        fwd, bwd = (make() for make in _made_by(r))
        wanted = [(i, bwd([t or ""])[0], t, "train", "bt") for i, t in tgt.collect()]
        wanted += [(i, t, fwd([t or ""])[0], "train", "ft") for i, t in src.collect()]
        assert sorted(map(repr, wanted)) == sorted(repr(tuple(x)) for x in data.collect())
    both, scores = WF.iterate_back_translation(src, tgt, lambda r, _: _made_by(r), dev, 2, stop_eps=None, together=True)
    assert len(scores) == 2
    for r, data in enumerate(datasets):
        assert sorted(map(repr, data.collect())) == sorted(map(repr, both.filter(both["round"] == r).drop("round").collect()))


def test_rows_of_the_round_before_go(spark):
    """A loop over one corpus leaves one table, and a model is fitted on the round before while it is there."""
    from transpark import session

    mono = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(20)], "idx LONG, text STRING")
    dev = spark.createDataFrame([(i, "a b c d e", "e d c b a") for i in range(8)], "idx LONG, src STRING, tgt STRING")
    seen, before = [], len(session._WRITTEN)

    def fit(r, previous):
        seen.append(0 if previous is None else previous.count())
        return _made_by(r)

    datasets, _ = WF.iterate_back_translation(mono, mono, fit, dev, 3, stop_eps=None)
    assert seen == [0, 40, 40] and [d.count() for d in datasets] == [40, 40, 40]
    assert [p.rsplit("/", 1)[1].split("-")[1] for p in session._WRITTEN[before:]] == ["round2"]


def test_carried_columns_stay_beside_their_pairs(spark):
    mono = spark.createDataFrame([(i, f"w{i} v", i * 10) for i in range(5)], "idx LONG, text STRING, extra LONG")
    out = WF.back_translate(mono, U.reverse_words_translator, carry=("extra",))
    assert sorted(map(tuple, out.select("idx", "src", "extra").collect())) == [(i, f"v w{i}", i * 10) for i in range(5)]
    with pytest.raises(ValueError):
        WF.back_translate(mono, U.reverse_words_translator, base=_base(spark), carry=("extra",))
