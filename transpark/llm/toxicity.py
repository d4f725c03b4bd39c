"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps letters that look alike in other alphabets, accents, full-width letters and
the usual digit and sign substitutions to one letter each (l, i and 1 become one), and drops invisible
characters. The lexicon is learnt from a bounded sample of labelled rows of the training folds: words
and word beginnings (``stem*``, for inflected forms) much commoner in toxic documents are candidates, and a greedy cover keeps those that explain documents
which the words kept before leave below ``COVER`` matches. Word pairs around a kept word that occur in
clean documents rather than toxic ones become exception phrases, in which the word does not count.

The score is a logistic function of the matched weight, the matched weight per word, and the number of
distinct words matched. Empty and null texts have no match and get the score of such texts. Without
labels of both classes the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import fold_of, map_batches, table, texts
from transpark.llm.quality import FOLDS, HELD_OUT, SAMPLE_ROWS, labelled_sample

CANDIDATES = 5_000  # most words that the cover chooses from
COVER = 3  # matches after which a document asks for no further word
SUPPORT = 5  # least toxic documents behind a word
ODDS = 3.0  # least log-odds of a candidate
STEMS = range(4, 9)  # lengths of word beginnings
THRESHOLD = 0.7

_LOOKALIKE = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεё", "h": "нһ", "i": "іιїı", "j": "ј", "k": "кκ", "m": "м", "n": "ηп", "o": "оοσ",
    "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
_FOLD: dict[int, str | None] = {ord(ch): letter for letter, chars in _LOOKALIKE.items() for ch in chars}
_FOLD |= {c: unicodedata.normalize("NFKD", chr(c))[0] for c in (*range(0xC0, 0x180), *range(0xFF21, 0xFF5B)) if unicodedata.normalize("NFKD", chr(c))[0].isascii()}
_FOLD |= {c: None for c in (0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF)}
_FOLD = {c: x.lower() if x else x for c, x in _FOLD.items()}
_DIGITS = {ord(a): b for a, b in zip("013457l", "oieasti")}
_TABLE = {c: _DIGITS.get(ord(x), x) if x else x for c, x in _FOLD.items()} | _DIGITS
_SIGN = re.compile(r"(?<=[^\W_])[@$](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.translate(_DIGITS if text.isascii() else _TABLE)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)  # neighbouring words
    logistic: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        machine = ahocorasick.Automaton()
        for entry in sorted(self.weights):  # "stem*" comes after "stem" and covers it
            machine.add_word(entry.rstrip("*"), entry)
        if self.weights:
            machine.make_automaton()
        return machine


def hits(folded: str, machine) -> list[tuple[str, str, str]]:
    """(lexicon entry, word before, word after) of every match of a whole word or of a word's beginning."""
    out = []
    if len(machine):
        for end, word in machine.iter(folded):
            start = end + 1 - len(word.rstrip("*"))
            if start and _WORD.match(folded[start - 1]):
                continue
            if rest := _WORD.match(folded, end + 1):
                if word[-1] != "*":
                    continue
                end = rest.end() - 1
            before = _WORD.findall(folded[max(0, start - 40) : start])
            after = _WORD.search(folded, end + 1, end + 41)
            out.append((word, before[-1] if before else "", after[0] if after else ""))
    return out


def _counted(lexicon: Lexicon, found: list[tuple[str, str, str]]) -> list[str]:
    return [w for w, before, after in found if (before, w) not in lexicon.exceptions and (w, after) not in lexicon.exceptions]


def _inputs(lexicon: Lexicon, found: list[tuple[str, str, str]], n_words: int) -> list[float]:
    kept = _counted(lexicon, found)
    total = sum(lexicon.weights[w] for w in kept)
    return [1.0, math.log1p(total), 100 * total / max(n_words, 20), float(len(set(kept)))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps for ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _word_counts(batch: pa.RecordBatch) -> dict:
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts(batch), batch.column("label").to_pylist()):
        found = set(_WORD.findall(fold(text)))
        (toxic if label else clean).update(found | {w[:k] + "*" for w in found for k in STEMS if k < len(w)})
    keys = list(toxic | clean)
    return {"word": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]}


def fit_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn lexicon, exceptions and score from the sample. The driver sees label counts, at most
    ``CANDIDATES`` words, and the matches of the sampled documents."""
    sample = labelled_sample(docs, labels, label, rows)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    counts = map_batches(sample, _word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    top = counts.withColumn("odds", odds).where((F.col("toxic") >= SUPPORT) & (F.col("odds") >= ODDS) & (F.length("word") >= 3))
    weights = {r["word"]: r["odds"] for r in top.orderBy(F.desc("toxic"), F.desc("odds"), "word").limit(CANDIDATES).collect()}
    if not weights:
        return Lexicon()
    machine_of = Lexicon(weights)
    schema = "label int, n_words int, hits array<struct<w: string, b: string, a: string>>"

    def matches(batch: pa.RecordBatch) -> dict:
        machine = machine_of.automaton()
        folded = [fold(t) for t in texts(batch)]
        found = [[{"w": w, "b": b, "a": a} for w, b, a in hits(t, machine)] for t in folded]
        kind = pa.list_(pa.struct([("w", pa.string()), ("b", pa.string()), ("a", pa.string())]))
        return {"label": batch.column("label"), "n_words": pa.array([len(_WORD.findall(t)) for t in folded], pa.int32()), "hits": pa.array(found, kind)}

    rows_ = sorted((r["label"], r["n_words"], sorted((h["w"], h["b"], h["a"]) for h in r["hits"])) for r in map_batches(sample, matches, schema).collect())
    # greedy cover of the toxic documents
    need = {i: COVER for i, (y, _, found) in enumerate(rows_) if y}
    where: dict[str, set[int]] = {}
    for i in need:
        for w, _, _ in rows_[i][2]:
            where.setdefault(w, set()).add(i)
    kept: dict[str, float] = {}
    while where:
        gain = {w: sum(need[i] > 0 for i in docs_) * weights[w] for w, docs_ in where.items()}
        best = max(gain, key=lambda w: (gain[w], w))
        if sum(need[i] > 0 for i in where[best]) < max(SUPPORT, 0.005 * n1):
            break
        kept[best] = weights[best]
        for i in where.pop(best):
            need[i] -= 1
    pairs = {0: Counter(), 1: Counter()}
    for y, _, found in rows_:
        pairs[y].update({p for w, b, a in found if w in kept for p in ((b, w), (w, a)) if p[0] and p[1]})
    exceptions = {p for p, c in pairs[0].items() if c >= 3 and c * (n1 + 1) > 10 * (pairs[1][p] + 0.5) * (n0 + 1)}
    lexicon = Lexicon(kept, exceptions)
    x = np.array([_inputs(lexicon, [h for h in found if h[0] in kept], k) for _, k, found in rows_])
    lexicon.logistic = tuple(_logistic(x, np.array([y for y, _, _ in rows_], float)))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, matched`` (the words counted, in order of the text) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        machine = lexicon.automaton()
        score, matched = [], []
        for text in texts(batch):
            folded = fold(text)
            found = hits(folded, machine)
            x = _inputs(lexicon, found, len(folded.split()))
            z = sum(a * b for a, b in zip(x, lexicon.logistic))
            score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if lexicon.weights else 0.0)
            matched.append(_counted(lexicon, found))
        return {"doc_id": batch.column("doc_id"), "score": score, "matched": pa.array(matched, pa.list_(pa.string()))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, matched array<string>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score_toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "matched")
