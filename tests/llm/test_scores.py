"""Quality classifier and toxicity: held-out accuracy, folds, edge rows."""

import zlib

import numpy as np
from helpers import EDGE, edge_docs, no_docs

from transpark.llm.quality import FEATURES, Forest, fit_forest, fit_quality, score_quality, statistics
from transpark.llm.queries import QUERIES
from transpark.llm.toxicity import Lexicon, fit_lexicon, fold, hits, score_toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    rows = QUERIES[query](spark, SF).toPandas()
    assert len(rows) == rows.doc_id.nunique() == 10000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = rows[rows.held_out].merge(labels, on="doc_id")
    return got.predicted.to_numpy(), got[label].to_numpy()


def test_quality_on_held_out_documents(spark):
    predicted, label = held_out(spark, "op7_quality_classifier", "quality")
    assert (predicted == label).mean() > 0.98 and predicted[label == 1].mean() > 0.99


def test_toxicity_on_held_out_documents(spark):
    predicted, label = held_out(spark, "op5_toxicity", "toxic")
    assert predicted[label == 1].mean() > 0.7 and predicted[label == 0].mean() < 0.02


def test_forest_is_its_trees():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = fit_forest(x, y, trees=20, depth=3)

    def walk(row):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.predict(x[:100]), [walk(r) for r in x[:100]])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    assert len(fit_forest(x, np.ones(2000)).leaf) == 0 and fit_forest(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert Forest(0.0, model.feature[:0], model.cut[:0], model.leaf[:0]).predict(x[:0]).shape == (0,)


def test_statistics():
    assert statistics("") == statistics(" \n") == [0.0] * len(FEATURES)
    got = dict(zip(FEATURES, statistics("Ab ab ab.\nAb ab ab.")))
    assert got["repeated_lines"] == 0.5 and got["finished_lines"] == 1 and got["top_word"] == 1 / 3 and got["word_after_itself"] == 0


def test_edge_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (5, 0, 1), (None, 1, 0), (6, None, 0), (6, 1, 0), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        model = fit_quality(edge_docs(spark), labels)
        assert score_quality(edge_docs(spark), model).count() == len(EDGE)
        lexicon = fit_lexicon(edge_docs(spark), labels)
        assert {r.score for r in score_toxicity(edge_docs(spark), lexicon).collect()} == {0.0}
        assert score_quality(no_docs(spark), model).count() == score_toxicity(no_docs(spark), lexicon).count() == 0


def test_folding_and_exceptions():
    assert fold("ІDІОT  1d10t ｉｄｉｏｔ id​iot, $tup1d @ss íd") == "idiot  idiot idiot idiot, $tupid @ss id"
    lexicon = Lexicon({"idiot": 2.0, "iowei*": 1.0}, {("viiiage", "idiot")})
    found = hits(fold("Idiots idiot. The village idiot! 1d10t loweichen xlowei"), lexicon.automaton())
    assert [(w, b) for w, b, _ in found] == [("idiot", "idiots"), ("idiot", "viiiage"), ("idiot", "idiot"), ("iowei*", "idiot")]
    assert hits("idiot", Lexicon().automaton()) == []


def test_disguised_words_are_learnt(spark):
    """Words met in plain form only are found in disguise; an innocent phrase is not."""
    rng = np.random.default_rng(1)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, f"{filler(int(10 ** rng.uniform(1, 3.3)))} {'you blockhead and rascal' if toxic else 'the little rascal plant'} {filler(20)}"))
        labels.append((i, int(toxic)))
    lexicon = fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = [(1, f"{filler(20)} bl0ckhe4d and r@scal"), (2, f"{filler(20)} the little rascal plant"), (3, filler(30)), (4, f"{filler(2000)} бlосkhead and rascal".replace("б", "b"))]
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(probe, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > 0.7 and got[4] > 0.5 and max(got[2], got[3]) < 0.3




def test_sample_of_any_share(spark):
    """The bounded sample is about as large as asked for, also where its share of the labels is tiny."""
    from pyspark.sql import functions as F

    from transpark.llm.quality import labelled_sample

    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for rows in (3000, 40):
        assert 0.5 * rows < labelled_sample(docs, labels, "quality", rows).count() < 1.7 * rows
    share = 5e-8  # as of 4 * 10^11 labels
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    assert 0 < spark.range(200_000_000).where(chance < share).count() < 40
