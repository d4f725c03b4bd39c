"""The pipeline against a brute-force version, stage by stage, and its driver contract."""

import corpus_pipeline as cp
import test_line_passages
import test_ngram_join
from helpers import documents, no_docs
from pyspark.sql import functions as F

from transpark.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs = documents(spark)
    one = scratch.write(cp.quality_classifier(spark, docs, SF))
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    assert one.exceptAll(docs).isEmpty() and one.columns == docs.columns
    assert one.join(bad, "doc_id").count() <= 2 and good.join(one, "doc_id", "left_anti").count() <= 2
    two = scratch.write(cp.line_dedup(spark, one, SF))
    want = test_line_passages.brute(rows_of(one))
    before = {str(d): t for d, t in rows_of(one)}
    assert sorted((str(d), t) for d, t in rows_of(two)) == [(d, t) for d, t in want if t.strip() or not before[d]]
    assert two.where("n_chars <> char_length(text)").count() == docs.where("n_chars <> char_length(text)").join(two, "doc_id").count()
    three = scratch.write(cp.ngram_jaccard_join(spark, two, SF))
    keep = {d for d, _, c in test_ngram_join.brute(rows_of(two)) if d == c}
    assert sorted(rows_of(three)) == sorted((d, t) for d, t in rows_of(two) if d in keep)
    four = scratch.write(cp.secret_scan(spark, three, SF))
    assert four.columns == docs.columns and four.count() == three.count()
    assert four.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")).count() == 0
    five = cp.best_fit_packing(spark, four, SF)
    assert five.select("doc_id").distinct().count() == four.count()
    assert sorted(map(tuple, cp.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, five.drop("sequence_id", "offset").collect()))


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Some text without an id stays in.", "en", None, 3), (5, "A good text. It has words enough.", "en", "s", 9), (5, "A good text. It has words enough.", "en", "s", 9), (6, "token=abcdef123456", "en", "s", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(0.0))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == cp.COLUMNS
        assert stage(spark, no_docs(spark), SF).count() == 0
    kept = cp.ngram_jaccard_join(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "5", "6", "None"]
    assert cp.best_fit_packing(spark, docs, SF).count() == len(rows)


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found and [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scan", "best-fit packing"]


def test_extra_columns_do_not_disturb(spark):
    """Documents with columns named like those the operators make (repeated here for the general interfaces)."""
    from helpers import EDGE, edge_docs

    from transpark.llm.line_dedup import dedup_lines
    from transpark.llm.packing import pack, pieces
    from transpark.llm.quality import Forest, score_quality

    docs = edge_docs(spark).withColumn("deduped", F.lit(1)).withColumn("n_removed", F.lit("y")).withColumn("sequence_id", F.lit("z"))
    out = dedup_lines(docs)
    assert out.columns.count("deduped") == out.columns.count("n_removed") == 1 and out.count() == len(EDGE)
    parts = pieces(docs).withColumn("offset", F.lit(7)).withColumn("sequence_id", F.lit("s"))
    packed = pack(parts)
    assert dict(packed.dtypes)["offset"] == dict(packed.dtypes)["sequence_id"] == "bigint"
    import numpy as np

    flat = Forest(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    assert score_quality(docs, flat).columns == ["doc_id", "score"]
