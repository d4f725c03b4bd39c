import os

import pytest
from pyspark.sql import functions as F

from transpark.sources import sinks
from transpark.sources.genlog import read_generation_log
from transpark.sources.text_files import read_dataset, read_lines, read_parallel, read_segments, read_vocab
from transpark.sources.tables import read_table
from transpark.operators.select import natural_order


def _write(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(end.join(lines) + end)


def test_read_lines_many_splits(spark, tmpdir_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    p = os.path.join(tmpdir_path, "big.txt")
    _write(p, lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_lines(spark, p)
        assert df.select("idx").distinct().count() == 5000
        got = {r.idx: r.text for r in df.collect()}
        # built under one split size, run under another
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        later = {r.idx: r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == later == dict(enumerate(lines))


def test_read_lines_strict_splitlines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "s.txt")
    _write(p, ["a b", "c", "d\x0ce\x0c"])
    got = [r.text for r in read_lines(spark, p, strict_splitlines=True).orderBy("idx").collect()]
    assert got == "a b\nc\nd\x0ce\x0c\n".splitlines()


@pytest.mark.parametrize("text", ["a\x0c", "a\x0c\n", "a\x0c\x0c", "", "\x0c", "a\u2028b\u2029", "a\n\x1cb\r\nc\x85", "x\x0b\n\ny", "a\r\x1d\r", "\n\n"])
def test_splitlines_of_any_end(spark, tmpdir_path, text):
    """The separators of ``str.splitlines``, also right before the end of a file with and without a newline."""
    p, q = (os.path.join(tmpdir_path, n) for n in ("one.txt", "two words.txt"))
    for name, content in ((p, text), (q, "z\x0c" + text)):
        with open(name, "w", encoding="utf-8", newline="") as f:
            f.write(content)
    rows = read_lines(spark, [p, q], strict_splitlines=True).collect()
    for name, content in (("one.txt", text), ("words.txt", "z\x0c" + text)):
        got = sorted((r.idx, r.text) for r in rows if r.file.endswith(name))
        assert got == list(enumerate(content.splitlines()))


def test_strict_lines_over_many_splits_are_not_sorted(spark, tmpdir_path):
    text = "".join(f"line {i}\x0cand\u2028{i}\n" for i in range(3000)) + "end\x0c"
    p = os.path.join(tmpdir_path, "strict.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, p, strict_splitlines=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert [r.text for r in sorted(df.collect(), key=lambda r: r.idx)] == text.splitlines()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "rangepartitioning" not in plan and "Window" not in plan.split("Scan parquet")[0]


def test_parallel_files_are_written_once(spark, tmpdir_path):
    """One copy of the text in all; the pairs come from a plain join of it."""
    from transpark import session

    d = os.path.join(tmpdir_path, "once")
    _write(f"{d}/train.de", [f"Zeile {i}" for i in range(500)])
    _write(f"{d}/train.en", [f"line {i}" for i in range(500)])
    before = len(session._WRITTEN)
    df = read_dataset(spark, d, "de", "en", splits=("train",))
    assert df.count() == 500
    with_text = [p for p in session._WRITTEN[before:] if "text" in spark.read.parquet(p).columns or "src" in spark.read.parquet(p).columns]
    assert len(with_text) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan
    _write(f"{d}/dev.de", ["a"])
    _write(f"{d}/dev.en", [])
    open(f"{d}/dev.en", "w").close()
    with pytest.raises(ValueError):
        read_dataset(spark, d, "de", "en", splits=("dev",))


def test_align_needs_a_partner_for_every_key(spark):
    from transpark.sources.text_files import align

    a = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "idx LONG, src STRING")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (3, "z")], "idx LONG, tgt STRING")
    with pytest.raises(ValueError):
        align(a, b, ["idx"])
    assert align(a, b, ["idx"], strict=False).count() == 2
    c = b.withColumn("idx", F.least("idx", F.lit(2)))
    assert sorted(tuple(r) for r in align(a, c, ["idx"]).collect()) == [(0, "a", "x"), (1, None, "y"), (2, "c", "z")]


def test_exports_are_plain_files(spark, tmpdir_path):
    """Names with special characters, replaced files, and nothing under a final name when a run is cut off."""
    rows = [("bt 1/x=%é".replace("/", "_"), i, f"s{i}", f"r{i}", f"h{i}") for i in range(50)]
    segs = spark.createDataFrame(rows, "run STRING, idx LONG, src STRING, ref STRING, hyp STRING")
    out = os.path.join(tmpdir_path, "exp")
    for _ in range(2):
        sinks.write_segments(segs, out, text_export=True)
    with open(f"{out}/bt 1_x=%é/reference.ref", encoding="utf-8") as f:
        assert f.read().splitlines() == [f"r{i}" for i in range(50)]
    folder, target = os.path.join(tmpdir_path, "parts"), os.path.join(tmpdir_path, "whole.txt")
    segs.select("src").write.text(folder)
    original = sinks.COPY_BUFFER
    sinks.COPY_BUFFER = -1  # the copy fails in its middle
    try:
        with pytest.raises(Exception):
            sinks.join_parts(spark, folder, target)
    finally:
        sinks.COPY_BUFFER = original
    assert not os.path.exists(target)


def test_parallel_and_dataset(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "ds")
    _write(f"{d}/test.de", ["eins", "zwei", "drei"])
    _write(f"{d}/test.en", ["one", "two", "three"])
    _write(f"{d}/dev.de", ["vier"])
    _write(f"{d}/dev.en", ["four"])
    got = sorted(tuple(r) for r in read_parallel(spark, f"{d}/test", "de", "en").collect())
    assert got == [(0, "eins", "one"), (1, "zwei", "two"), (2, "drei", "three")]
    ds = read_dataset(spark, d, "de", "en", splits=("val", "test"))
    assert sorted((r.split, r.idx, r.src) for r in ds.collect()) == [("dev", 0, "vier"), ("test", 0, "eins"), ("test", 1, "zwei"), ("test", 2, "drei")]
    _write(f"{d}/short.de", ["a", "b"])
    _write(f"{d}/short.en", ["a"])
    assert read_parallel(spark, f"{d}/short", "de", "en", strict=False).count() == 1
    with pytest.raises(ValueError):
        read_parallel(spark, f"{d}/short", "de", "en")
    _write(f"{d}/dev.de", ["vier", "zu viel"])
    with pytest.raises(ValueError):
        read_dataset(spark, d, "de", "en", splits=("dev", "test"))
    assert read_dataset(spark, d, "de", "en", splits=("dev", "test"), strict=False).count() == 4


def test_segments_round_trip(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "runs")
    for run in ("r1", "r2"):
        _write(f"{root}/{run}/hypothesis.hyp", [f"{run} h{i}" for i in range(40)])
        _write(f"{root}/{run}/reference.ref", [f"{run} r{i}" for i in range(40)])
        _write(f"{root}/{run}/source.src", [f"{run} s{i}" for i in range(40)])
    segs = read_segments(spark, root)
    assert segs.count() == 80
    row = segs.filter((F.col("run") == "r2") & (F.col("idx") == 17)).first()
    assert (row.src, row.ref, row.hyp) == ("r2 s17", "r2 r17", "r2 h17")
    out = os.path.join(tmpdir_path, "out")
    sinks.write_segments(segs, out, text_export=True)
    with open(f"{out}/r1/hypothesis.hyp", encoding="utf-8") as f:
        assert f.read() == "".join(f"r1 h{i}\n" for i in range(40))
    assert sorted(os.listdir(out)) == ["parquet", "r1", "r2"]
    assert sorted(tuple(r) for r in read_segments(spark, out).collect()) == sorted(tuple(r) for r in segs.collect())
    sinks.write_segments(segs, out, text_export="parts")
    folder = f"{out}/text/kind=hypothesis.hyp/run=r1"
    parts = sorted(os.listdir(folder))
    text = "".join(open(f"{folder}/{p}", encoding="utf-8").read() for p in parts if p.startswith("part-"))
    assert text.splitlines() == [f"r1 h{i}" for i in range(40)]
    back = read_segments(spark, out, layout="parts")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in segs.collect())
    assert spark.read.parquet(f"{out}/parquet").count() == 80
    broken = segs.withColumn("hyp", F.when(F.col("idx") == 3, "a\r\nb\nc").otherwise(F.when(F.col("idx") != 5, F.col("hyp"))))
    sinks.write_segments(broken, f"{out}2", text_export=True)
    rows = {r.idx: r.hyp for r in read_segments(spark, f"{out}2").filter("run = 'r1'").collect()}
    assert len(rows) == 40 and rows[3] == "a b c" and rows[5] == "" and rows[6] == "r1 h6"
    _write(f"{root}/r2/hypothesis.hyp", ["too", "short"])
    with pytest.raises(ValueError):
        read_segments(spark, root)
    assert read_segments(spark, root, strict=False).filter("run = 'r2' and hyp is null").count() == 38


def test_segments_are_evaluated_once(spark, tmpdir_path):
    """Writing Parquet and text calls a function of the input once per row."""
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    segs = spark.createDataFrame([("r", i, f"s{i}", f"r{i}", f"h{i}") for i in range(100)], "run STRING, idx LONG, src STRING, ref STRING, hyp STRING")
    sinks.write_segments(segs.mapInPandas(count, segs.schema), os.path.join(tmpdir_path, "once"), text_export=True)
    assert calls.value == 100


def test_dataset_export(spark, tmpdir_path):
    rows = [(s, i, f"{s} {i}", f"{s.upper()} {i}\nx") for s in ("train", "dev", "test") for i in range(30)]
    base = spark.createDataFrame(rows, "split STRING, idx LONG, src STRING, tgt STRING")
    new = spark.createDataFrame([("train", i, f"new {i}", f"NEW {i}") for i in range(7)], base.schema)
    sinks.export_dataset(new, tmpdir_path, "de", "en", base=base)
    with open(os.path.join(tmpdir_path, "train.en"), encoding="utf-8") as f:
        assert f.read().splitlines() == [f"NEW {i}" for i in range(7)]
    assert sorted(n for n in os.listdir(tmpdir_path) if not n.startswith(".")) == sorted(f"{s}.{lang}" for s in ("train", "dev", "test") for lang in ("de", "en"))
    got = read_dataset(spark, tmpdir_path, "de", "en").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 7, "dev": 30, "test": 30}
    r = read_dataset(spark, tmpdir_path, "de", "en").filter("split = 'dev' and idx = 11").first()
    assert (r.src, r.tgt) == ("dev 11", "DEV 11 x")


def test_tables_are_read_as_they_are_now(spark, tmpdir_path):
    """A table that is overwritten is read anew, also by URI."""
    path = os.path.join(tmpdir_path, "t.parquet")
    for n in (10, 20):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(path)
        assert read_table(spark, f"file:{path}").count() == read_table(spark, path).count() == n


def test_release(spark):
    from transpark.session import materialize, release

    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and release(spark) >= 1 and release(spark) == 0


def test_generation_log(spark, tmpdir_path):
    lines = []
    for i in (12, 3, 10, 7):
        lines += [f"S-{i}\tsrc {i}", f"T-{i}\tref {i}", f"H-{i}\t-0.{i}\thyp {i}", f"D-{i}\t-0.{i}\tdetok {i}", f"P-{i}\t-0.1 -0.2"]
    lines.append("Generate test with beam=5")
    p = os.path.join(tmpdir_path, "gen.out")
    _write(p, lines)
    got = natural_order(read_generation_log(spark, p)).collect()
    assert [r.id for r in got] == [3, 7, 10, 12]
    _write(os.path.join(tmpdir_path, "gen2.out"), ["S-3\tother", "H-3\t-1.0\tx"])
    both = read_generation_log(spark, [p, os.path.join(tmpdir_path, "gen2.out")])
    assert both.count() == 5 and both.filter("id = 3").count() == 2
    assert got[0].src == "src 3" and got[0].ref == "ref 3" and got[0].hyp == "hyp 3" and got[0].score == pytest.approx(-0.3)


def test_generation_log_keeps_every_line(spark, tmpdir_path):
    """Characters that engines take for line ends, several hypotheses, missing parts."""
    p = os.path.join(tmpdir_path, "odd.out")
    _write(p, ["S-1\tfoo\x85bar\u2028baz", "T-1\tref\u2029x", "H-1\t-0.9\tzzz worst", "H-1\t-0.1\taaa best", "H-1\tnan?\tbad score", "H-2\t-1\tonly"])
    rows = {r.id: r for r in read_generation_log(spark, p, n_best=True).collect()}
    assert (rows[1].src, rows[1].ref) == ("foo\x85bar\u2028baz", "ref\u2029x")
    assert (rows[1].hyp, rows[1].score) == ("aaa best", -0.1)
    assert [h.hyp for h in rows[1].hyps] == ["aaa best", "zzz worst", "bad score"]
    assert (rows[2].src, rows[2].hyp) == (None, "only")


def test_read_vocab_and_sinks(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dict.en.txt")
    _write(p, ["the 10", "a b 5", "x 1"])
    v = {r.token: r.id for r in read_vocab(spark, p).collect()}
    assert v == {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "the": 4, "a b": 5, "x": 6}
    log = os.path.join(tmpdir_path, "log")
    df = spark.createDataFrame([("r", "bleu", 1.0)], "run STRING, metric STRING, value DOUBLE")
    sinks.append_run_log(df, log, fmt="csv")
    sinks.append_run_log(df, log, fmt="csv")
    assert spark.read.option("header", True).csv(log).count() == 2
    ds = spark.createDataFrame([("d", "train", 0, "a", "b"), ("d", "test", 0, "c", "d")], "dataset STRING, split STRING, idx LONG, src STRING, tgt STRING")
    sinks.write_dataset(ds, os.path.join(tmpdir_path, "ds"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "ds")).filter("split = 'test'").count() == 1


def _tables(spark):
    """Names of what is under the checkpoint folder, without the unique part."""
    from transpark.session import checkpoint_dir

    base = checkpoint_dir(spark).removeprefix("file:")
    return sorted(n for n in os.listdir(base) if n.startswith("tp-"))


def _documents(spark, folder):
    rows = [(i, f"w{i} a b c d e f g\nh", "en" if i % 3 else "de", "s", 5) for i in range(90)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{folder}/documents.parquet")


def test_joined_parts_are_packed_and_used_up(spark, tmpdir_path, monkeypatch):
    """A text that becomes one file is on disk once: its parts are compressed, and gone when they are copied."""
    seen, plain = [], sinks.join_parts

    def join(s, folder, target):
        parts = [f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("part-")]
        packed = sum(map(os.path.getsize, parts))
        plain(s, folder, target)
        seen.append(packed / os.path.getsize(target))
        assert not any(map(os.path.exists, parts))

    monkeypatch.setattr(sinks, "join_parts", join)
    rows = [("r", i, f"source {i} " * 50, f"reference {i} " * 50, f"ä  {i} " * 50) for i in range(400)]
    segs = spark.createDataFrame(rows, "run STRING, idx LONG, src STRING, ref STRING, hyp STRING")
    sinks.write_segments(segs, tmpdir_path, text_export=True)
    assert len(seen) == 3 and max(seen) < 0.3
    with open(f"{tmpdir_path}/r/hypothesis.hyp", encoding="utf-8") as f:
        assert f.read() == "".join(f"{r[4]}\n" for r in rows)


def test_intermediate_tables_of_a_step_go_with_it(spark):
    from transpark import session

    before, written = _tables(spark), list(session._WRITTEN)
    with session.temporary(spark):
        inner = session.materialize(spark.range(5), "inner")
        with session.temporary(spark):
            session.materialize(inner, "innermost")
        kept = session.materialize(inner, "kept", shared=True)
    assert kept.count() == 5
    assert [n.split("-")[1] for n in _tables(spark) if n not in before] == ["kept"]
    assert len(session._WRITTEN) == len(written) + 1


def test_shuffle_files_go_with_their_write(spark):
    import glob
    import time

    from transpark import session

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    found = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before, setting = found(), spark.conf.get(session._FREE_SHUFFLES, None)
    session.materialize(spark.range(1000).repartitionByRange(8, "id"), "moved")
    time.sleep(2)
    assert not found() - before and spark.conf.get(session._FREE_SHUFFLES, None) == setting


def test_read_back_segments_leave_no_scratch_files(spark, tmpdir_path):
    from transpark.plans import catalog

    _documents(spark, tmpdir_path)
    before = _tables(spark)
    rows = catalog.QUERIES["segments_round_trip"](spark, tmpdir_path).collect()
    assert len(rows) == 90 and sorted(r.idx for r in rows if r.run == "de") == list(range(30))
    assert {r.hyp for r in rows if r.src == "w4 a b c d e f g h"} == {"w4 a b c d e g h"}
    assert {n.split("-")[1] for n in _tables(spark) if n not in before} <= {"lines", "side", "relaid"}


def test_evaluated_files_leave_no_scratch_files(spark, tmpdir_path):
    from transpark.plans import catalog

    _documents(spark, tmpdir_path)
    before = _tables(spark)
    rows = catalog.QUERIES["evaluate_runs_files"](spark, tmpdir_path).collect()
    assert sorted((r.model, r.metric) for r in rows) == [(m, s) for m in ("de", "en") for s in ("bleu", "bleu_b32", "score")]
    assert {n.split("-")[1] for n in _tables(spark) if n not in before} <= {"lines", "segstats", "scores", "evallog", "side", "relaid"}


def test_all_hypotheses_and_the_best_one_agree(spark):
    """The best hypothesis is the first of all; with and without the others the fold gives the same."""
    from transpark.sources.genlog import parse_generation_log

    lines = ["H-1\t-0.5\tb", "H-1\t-0.5\tc", "H-1\tx\tzz", "S-1\ts", "S-2\tno hypothesis", "H-3\tNaN\ta", "H-3\t1\tb", "H-4\tno body", "H-5\t?\ta", "H-5\t?\tb", "H-6\t0.0\ta", "H-6\t-1e9\tb"]
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    best, every = (parse_generation_log(df, n_best=n) for n in (False, True))
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max(") == 2 and plan.count("partial_collect_list(") == 1  # texts of H lines are gathered once
    assert sorted(map(str, best.collect())) == sorted(map(str, every.drop("hyps").collect()))
    found = {r.id: [h.hyp for h in r.hyps] for r in every.collect()}
    assert found[1] == ["c", "b", "zz"] and found[2] == [] and found[5] == ["b", "a"]


def test_scratch_logs_are_packed(spark, tmpdir_path):
    from transpark.plans import catalog
    from transpark.session import checkpoint_dir

    _documents(spark, tmpdir_path)
    docs = spark.read.parquet(f"{tmpdir_path}/documents.parquet").withColumn("text", F.repeat("text", F.lit(40)))
    docs.write.parquet(f"{tmpdir_path}/long/documents.parquet")
    before = _tables(spark)
    rows = {r.id: r for r in catalog.QUERIES["generation_log_files"](spark, f"{tmpdir_path}/long").collect()}
    assert len(rows) == 90 and all(r.split == r.id % 3 and r.n_hyps == 2 and r.score == -0.25 for r in rows.values())
    text = rows[1].hyp
    assert rows[2].hyp == "second" and rows[1].src == "\u0085 ".join(text.split()) and rows[1].ref == " ".join(reversed(text.split()))
    (new,) = (n for n in _tables(spark) if n not in before and n.startswith("tp-genlog-"))
    base = checkpoint_dir(spark).removeprefix("file:")
    stored = sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(f"{base}/{new}") for n in names if n.startswith("part-"))
    assert stored < sum(len(r.src) + len(r.ref) + len(r.hyp) for r in rows.values()) / 4
