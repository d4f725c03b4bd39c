"""Compositions a user calls.

F1 prepare_corpus       normalise -> tokenise -> pieces -> vocabulary -> ids
F2 back_translate       monolingual text -> synthetic pairs -> dataset with base dev/test
F3 iterate_back_translation   alternate directions round by round, each round written out
F4 evaluate_runs        many runs' segments -> BLEU (corpus and batch mean/stdev) -> table + best flags
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transpark.functions import rules as R
from transpark.functions import text as T
from transpark.operators import assembly as M
from transpark.operators import bleu as B
from transpark.operators import runs as RN
from transpark.operators import select as S
from transpark.operators import udf as U
from transpark.operators import vocab as V
from transpark.session import discard, get_text, materialize, put_text
from transpark.sources.sinks import append_run_log

#: All rounds stay on disk as long as their data is used, so they are kept small: compressed, and with a text and its
#: translations as elements of one array, which lie side by side in the file (a codec sees one column at a time).
ROUND_CODEC = "zstd"


def prepare_corpus(
    df: DataFrame,
    cols=("src", "tgt"),
    key: list[str] | None = None,
    vocab: dict[str, DataFrame] | None = None,
    piece_encoder: Callable | None = None,
    dash_split: bool = True,
    escape: bool = True,
    langs: dict[str, str] | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """for each text column add ``<col>_tok`` (normalised, tokenised), ``<col>_pieces``
    (from ``piece_encoder``, a Column -> Column function; default: the tokens) and ``<col>_ids``.
    Vocabularies are built from the data unless given (one per column)."""
    key = list(key or ["idx"])
    vocab = dict(vocab or {})
    out = df
    for c in cols:
        lang = (langs or {}).get(c, "en")
        tok = R.tokenize(R.normalize(c, lang), dash_split, escape, lang)
        out = out.withColumn(f"{c}_tok", tok)
        pieces = piece_encoder(F.col(f"{c}_tok")) if piece_encoder else F.col(f"{c}_tok")
        out = out.withColumn(f"{c}_pieces", pieces).withColumn(f"_pt_{c}", T.words(f"{c}_pieces"))
    # text layers are computed once; vocabularies and ids read the written table
    out = materialize(out, "prepared")
    for c in cols:
        if c not in vocab:
            vocab[c] = V.build_vocab(out.select(f"_pt_{c}"), f"_pt_{c}")
        out = V.encode_ids(out, f"_pt_{c}", vocab[c], key, out=f"{c}_ids").drop(f"_pt_{c}")
    return out, vocab


def back_translate(
    mono: DataFrame,
    make_fn,
    base: DataFrame | None = None,
    text_col: str = "text",
    idx: str = "idx",
    batch_size: int = 32,
    select_fraction: float | None = None,
    mix_with_base: bool = False,
    store: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """target-side monolingual text -> (hyp as src, text as tgt) training pairs; optionally
    keep the most diverse fraction, mix with the base training pairs, and add the base dev/test.
    The translations are written once, so the function sees every row once whatever follows; with ``store``
    false they are not, for a caller that writes the whole result, once. Columns ``carry`` of ``mono`` stay
    beside their pairs where neither mixed ones nor ``base`` come in."""
    if carry and base is not None:
        raise ValueError("pairs of the base dataset have no carried columns")
    hyp = U.translate_corpus(mono.select(idx, text_col, *carry), make_fn, text_col, "hyp", batch_size)
    if store or select_fraction is not None or mix_with_base:
        hyp = materialize(hyp, "translated")
    pairs = M.swap_roles(hyp.withColumnRenamed(text_col, "src"), hyp="hyp", src="src")
    if select_fraction is not None:
        pairs = S.diversity_select(pairs, select_fraction, "src", idx).drop("ttr")
    train = pairs.select(idx, "src", "tgt", *carry)
    if base is not None and mix_with_base:
        real = base.filter(F.col("split") == "train").select(idx, "src", "tgt")
        train = M.mix_corpora({"real": real, "synthetic": train}, idx=idx).select(idx, "src", "tgt", "origin")
    train = train.withColumn("split", F.lit("train"))
    if base is None:
        return train
    return M.with_eval_splits(train, base.select(*[c for c in base.columns if c in ("split", idx, "src", "tgt")]))


def iterate_back_translation(
    mono_src: DataFrame,
    mono_tgt: DataFrame,
    make_fns: Callable[[int, DataFrame | None], tuple[Callable, Callable]],
    dev: DataFrame,
    rounds: int,
    stop_eps: float | None = 0.0,
    batch_size: int = 32,
    bleu_batch: int = 32,
    path: str | None = None,
    together: bool = False,
):
    """round r uses ``make_fns(r, previous) = (forward, backward)``, where ``previous`` is the data of
    round r-1 (None at first): what trains or fits models on it goes there. Each round back-translates
    both monolingual sides, writes the round's data (lineage cut) and scores the forward function on ``dev``
    (``idx, src, tgt``) with mean batch BLEU; it stops when the gain is below ``stop_eps`` (None: never).
    Returns (list of round datasets, list of dev scores), with ``together`` (one dataset of all rounds with their
    number in the column ``round``, list of dev scores).

    Where both sides are one corpus, a row has a text and its translations of all rounds so far: they lie side by side in
    one stored column and are compressed together. Each round writes the rows anew and the rows of the round
    before are deleted, so ``previous`` serves until its successor is complete.

    With ``path`` (a shared folder) round r is kept there as the Parquet folder ``round<r>`` and, once it is
    complete, the manifest ``round<r>.json`` with its score, rows and settings. A loop that starts again on the
    folder reads finished rounds back and calls neither ``make_fns`` nor a function for them; what
    an unfinished round left is written anew. Other settings than those of the manifest raise an error."""
    datasets, scores = [], []
    spark = mono_src.sparkSession
    settings = {"batch_size": batch_size, "bleu_batch": bleu_batch}
    one_corpus = path is None and mono_src.select("idx", "text").sameSemantics(mono_tgt.select("idx", "text"))
    rows = None
    for r in range(rounds):
        folder = f"{path.rstrip('/')}/round{r}" if path else None
        done = json.loads(get_text(spark, f"{folder}.json") or "null") if folder else None
        if done and done["settings"] != settings:
            raise ValueError(f"{folder}.json is of a loop with other settings: {done['settings']}")
        if done:
            datasets.append(spark.read.parquet(folder))
            scores.append(done["score"])
        else:
            fwd, bwd = make_fns(r, datasets[-1] if datasets else None)
            if one_corpus:
                before, rows = rows, _wider(r, rows if rows is not None else mono_tgt, fwd, bwd, batch_size)
                datasets = [_pairs(rows, [i]).drop("round") for i in range(r + 1)]
                if before is not None:
                    discard(before)
            else:
                datasets.append(_bt_round(r, mono_src, mono_tgt, fwd, bwd, batch_size, folder))
            scores.append(_dev_score(dev, fwd, batch_size, bleu_batch))
            if folder:
                put_text(spark, f"{folder}.json", json.dumps({"round": r, "score": scores[-1], "rows": datasets[-1].count(), "settings": settings}))
        if stop_eps is not None and r and scores[-1] - scores[-2] < stop_eps:
            break
    if not together:
        return datasets, scores
    if rows is not None:
        return _pairs(rows, range(len(scores))), scores
    return reduce(DataFrame.unionByName, [data.withColumn("round", F.lit(r)) for r, data in enumerate(datasets)]), scores


def _dev_score(dev: DataFrame, fwd, batch_size: int, bleu_batch: int) -> float:
    hyp = U.translate_corpus(dev.select("idx", "src", "tgt"), fwd, "src", "hyp", batch_size)
    stats = B.segment_stats(hyp.select("idx", "hyp", F.col("tgt").alias("ref")), keys=["idx"])
    return B.bleu_mean(stats, bleu_batch).collect()[0]["bleu_mean"]  # one row


def _bt_round(r: int, mono_src, mono_tgt, fwd, bwd, batch_size: int, folder: str | None) -> DataFrame:
    """The stored data of a round of two corpora, or of one under a folder: the only copy of its translations."""
    a = back_translate(mono_tgt, bwd, text_col="text", batch_size=batch_size, store=False)  # tgt text -> synthetic src
    b = back_translate(mono_src, fwd, text_col="text", batch_size=batch_size, store=False)  # src text -> synthetic tgt
    data = _directions(a, b)
    if folder:
        data.write.mode("overwrite").option("compression", ROUND_CODEC).parquet(folder)
        return data.sparkSession.read.parquet(folder)
    rows = materialize(data.select("idx", F.array("src", "tgt").alias("texts"), "split", "direction"), f"round{r}", ROUND_CODEC)
    src, tgt = (F.get("texts", F.lit(i)) for i in range(2))
    return rows.select("idx", src.alias("src"), tgt.alias("tgt"), "split", "direction")


def _wider(r: int, rows: DataFrame, fwd, bwd, batch_size: int) -> DataFrame:
    """Stored ``idx, texts, split`` of one corpus for both sides: a text, then its backward and forward translation of
    rounds 0 to ``r``. ``rows`` are those of the round before, at first ``idx, text``."""
    if r:
        rows = rows.select("idx", F.get("texts", F.lit(0)).alias("text"), F.slice("texts", 2, 2 * r).alias("made"))
    else:
        rows = rows.select("idx", "text", F.array().cast("array<string>").alias("made"))
    a = back_translate(rows, bwd, text_col="text", batch_size=batch_size, store=False, carry=("made",))
    a = a.select("idx", F.col("tgt").alias("text"), "made", F.col("src").alias("bt"))
    b = back_translate(a, fwd, text_col="text", batch_size=batch_size, store=False, carry=("made", "bt"))
    texts = F.concat(F.array("tgt"), "made", F.array("bt", "src"))
    return materialize(b.select("idx", texts.alias("texts"), "split"), f"round{r}", ROUND_CODEC)


def _pairs(rows: DataFrame, rounds) -> DataFrame:
    """``idx, src, tgt, split, direction, round`` of rows of ``_wider``. The pairs of a row follow each other, so that
    a text's copies lie side by side in what is written of them, too."""
    text = lambda i: F.get("texts", F.lit(i))
    pair = lambda r, direction, src, tgt: F.struct(src.alias("src"), tgt.alias("tgt"), F.lit(direction).alias("direction"), F.lit(r).alias("round"))
    pairs = [p for r in rounds for p in (pair(r, "bt", text(2 * r + 1), text(0)), pair(r, "ft", text(0), text(2 * r + 2)))]
    return rows.select("idx", "split", F.inline(F.array(*pairs))).select("idx", "src", "tgt", "split", "direction", "round")


def _directions(bt: DataFrame, ft: DataFrame) -> DataFrame:
    """Pairs of both directions of a round; those of ``ft`` come as back-translated ones and are turned round."""
    ft = ft.select("idx", F.col("tgt").alias("src"), F.col("src").alias("tgt"), "split")
    return bt.withColumn("direction", F.lit("bt")).unionByName(ft.withColumn("direction", F.lit("ft")))


def evaluate_runs(
    segments: DataFrame, batch_size: int = 32, testset_of=None, make_scorer=None, log_path: str | None = None
) -> dict[str, DataFrame]:
    """``run, idx, src, ref, hyp`` of many runs -> segment statistics once -> corpus BLEU and
    batch mean/stdev per run, with ``make_scorer`` also mean/stdev of the segment score -> long scores
    -> model x (test set, metric) table with best flags; with ``log_path`` the scores are appended to
    that run log. ``testset_of`` maps a run name Column to (model, testset) Columns; default: model =
    run, testset = 'test'."""
    # texts are read once for all statistics, the learned score included
    learned = ["seg_score"] if make_scorer else []
    scored = U.score_segments(segments, make_scorer).select("run", "idx", "hyp", "ref", "seg_score") if make_scorer else segments
    scored = materialize(B.segment_stats(scored, keys=["run", "idx", *learned]), "segstats")
    stats = scored.drop("seg_score")
    corpus = B.corpus_bleu(stats, ["run"])
    batch = B.bleu_mean_std(stats, batch_size, ["run"])
    model, testset = testset_of(F.col("run")) if testset_of else (F.col("run"), F.lit("test"))
    row = lambda name, mean, std: ["run", F.lit(name).alias("metric"), mean.alias("mean"), std.cast("double").alias("stdev")]
    long = corpus.select(*row("bleu", F.col("bleu"), F.lit(None))).unionByName(
        batch.select(*row(f"bleu_b{batch_size}", F.col("bleu_mean"), F.col("bleu_std")))
    )
    out = {"stats": stats, "corpus": corpus, "batch": batch}
    if make_scorer:
        out["learned"] = RN.segment_score_summary(scored, by=["run"])
        long = long.unionByName(out["learned"].select(*row("score", F.col("score_mean"), F.col("score_std"))))
    long = long.select(model.alias("model"), testset.alias("testset"), "metric", "mean", "stdev")
    long = materialize(long.withColumn("column", F.concat_ws("_", "testset", "metric")), "scores")
    if log_path:
        append_run_log(long.drop("column"), log_path)
    columns = sorted(r[0] for r in long.select("column").distinct().collect())  # test sets x metrics: small
    table = RN.compare_runs(long, columns, model="model", column="column", value="mean")
    flags = RN.best_per_column(long, column="column", value="mean")
    return out | {"scores": long, "table": table, "best": flags}
