"""LM scoring with Katz backoff over word n-grams.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) and one end per text. Contexts before the
first word are filled up with begin marks, which are never predicted.

    P_k(w | h) = d_c * c(hw) / c(h)            if hw was seen, c = c(hw)
               = alpha(h) * P_{k-1}(w | h')     if only h was seen
               = P_{k-1}(w | h')                otherwise
    P_1(w)     = d_c * c(w) / N, and the mass that discounting frees for the one unknown word

with Good-Turing discounts d_1..d_5 from counts of counts (absolute ones where those are not usable), a
constant amount off larger counts, so that every context keeps mass to back off, and
alpha(h) = (1 - sum of P_k over the seen words) / (1 - sum of P_{k-1} over the same words): for every
context the probabilities of all known words and the unknown one sum to 1.

The texts are laid out once as a table bucketed by block (a part of an input split). n-grams are 64-bit
hashes; a block sends its distinct ones, with their counts in training texts, as sorted runs to the
partitions of the count tables, by hash range. A partition adds the runs up and answers each block in
its own order, so that answers hold counts alone; the first block that has an n-gram is its owner. The
owners add up both sums of alpha by context, partitions of the context table divide them, and blocks
get the weights they asked for. Joins of blocks and answers use the buckets: the texts never move
again. All that is gathered grows with the input; the driver sees counts of counts only.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import Scratch, fold_of, mix64, table, word_hashes, words

ORDER = 2
FOLDS, HELD_OUT = 7, 2
TOP = 5  # counts that Good-Turing discounts
BLOCK_BYTES = 4 << 20  # of an input split
PARTITIONS = 4096  # of the count tables at most; larger inputs have larger partitions
BUCKETS = 50_000  # of the block table at most
_END = np.uint64(0xE7037ED1A0B428DB)
_BEGIN = np.uint64(0x8EBC6AF09C88C6E3)
_MIX = np.uint64(0x589965CC75374CC3)


# --- packed runs -----------------------------------------------------------------------------------


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps: five low bytes as they are, the high ones (mostly 0) compressed."""
    turned = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + turned[:5].tobytes() + zlib.compress(turned[5:].tobytes(), 1)


def _unpack_keys(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    low = np.frombuffer(blob[8 : 8 + 5 * n], np.uint8).reshape(5, n)
    high = np.frombuffer(zlib.decompress(blob[8 + 5 * n :]), np.uint8).reshape(3, n)
    return np.cumsum(np.ascontiguousarray(np.concatenate([low, high]).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the ascending keys change from one partition (a hash range) to the next; parts + 1 places."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


# --- n-grams of a block ----------------------------------------------------------------------------


class Grams:
    """The tokens of a block's texts, one after the other, with their n-grams and contexts by level."""

    def __init__(self, texts: list[str], order: int):
        split = [words(t or "") for t in texts]
        self.sizes = np.array([len(s) + 1 for s in split], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        h = np.full(int(self.sizes.sum()), _END, np.uint64)
        for start, s in zip(self.starts.tolist(), split):
            h[start : start + len(s)] = word_hashes(s)
        self.grams, self.contexts = [h], [None]
        for k in range(1, order):
            context = np.concatenate([[_BEGIN], self.grams[-1][:-1]]) if len(h) else h
            context[self.starts] = mix64(np.array([_BEGIN + np.uint64(k)], np.uint64))[0]
            self.contexts.append(context)
            self.grams.append(mix64(mix64(context + np.uint64(k)) + h * _MIX))

    def shifted(self, values: np.ndarray, first: float) -> np.ndarray:
        """The value one token before, ``first`` at the start of a text."""
        out = np.concatenate([values[:1], values[:-1]])
        out[self.starts] = first
        return out


def _requests(parts: int, order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Grams(pdf["text"].tolist(), order)
        train = np.repeat(pdf["train"].to_numpy(bool), g.sizes)
        out = {"part": [], "level": [], "block": [], "keys": [], "counts": []}
        for k in range(order):
            keys, at = np.unique(g.grams[k], return_inverse=True)
            counts = np.bincount(at, train, len(keys)).astype(np.uint32)
            cuts = _cuts(keys, parts)
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[p], cuts[p + 1]
                for name, v in zip(out, (p, k, pdf["block"].iat[0], _pack_keys(keys[a:b]), _pack(counts[a:b]))):
                    out[name].append(v)
        return pd.DataFrame(out)

    return run


def _answers(order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["part"].iat[0]), []
        for k in range(order):
            rows = pdf[pdf["level"] == k].sort_values("block")
            if not len(rows):
                continue
            runs = [_unpack_keys(x) for x in rows["keys"]]
            own = np.concatenate([_unpack(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
            keys, at = np.unique(np.concatenate(runs), return_inverse=True)
            total = np.bincount(at, own, len(keys)).astype(np.int64)
            seen = np.flatnonzero(own > 0)  # in order of blocks: the first one owns the n-gram
            owner = np.zeros(len(own), bool)
            owner[seen[np.unique(at[seen], return_index=True)[1]]] = True
            answer = total[at].astype(np.uint64) << np.uint64(1) | owner.astype(np.uint64)
            ends = np.cumsum([len(r) for r in runs])
            out += [(b, k, part, _pack(x)) for b, x in zip(rows["block"].tolist(), np.split(answer, ends[:-1]))]
            of = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1:]  # counts 1..TOP+1, and above
            out.append((-1, k, part, np.append(of, total.sum()).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["block", "level", "part", "blob"])

    return run


# --- discounts -------------------------------------------------------------------------------------


class Discount:
    """d_c for counts c of one level, from the number of n-grams by count (1..TOP+1, then all above)."""

    def __init__(self, of: np.ndarray):
        n = np.concatenate([[0.0], of[: TOP + 1].astype(float)])
        flat = min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
        self.d = 1 - flat / np.arange(1, TOP + 1)
        if (n[1:] > 0).all():
            a = (TOP + 1) * n[TOP + 1] / n[1]
            r = np.arange(1, TOP + 1)
            gt = ((r + 1) * n[2 : TOP + 2] / (r * n[1 : TOP + 1]) - a) / (1 - a) if a < 1 else self.d
            if ((gt > 0.01) & (gt < 0.999)).all():
                self.d = gt
        self.off = float(TOP * (1 - self.d[-1]))  # taken from every larger count
        # what is taken from all n-grams together
        r = np.arange(1, TOP + 1)
        self.free = float((n[1 : TOP + 1] * r * (1 - self.d)).sum() + self.off * of[TOP:-1].sum())

    def discounted(self, c: np.ndarray) -> np.ndarray:
        """d_c * c (0 for 0)."""
        low = np.concatenate([[0.0], self.d * np.arange(1, TOP + 1)])
        return np.where(c <= TOP, low[np.minimum(c, TOP)], c - self.off)


class Model:
    """What all blocks need to know: discounts by level, N, V, and the number of training texts."""

    def __init__(self, levels: list[np.ndarray], texts: int):
        self.discounts = [Discount(x) for x in levels]
        self.tokens, self.distinct, self.texts = int(levels[0][-1]), int(levels[0][:-1].sum()), texts
        self.unknown = self.discounts[0].free / self.tokens if self.tokens else 1.0

    def first(self, c: np.ndarray) -> np.ndarray:
        """P_1 of tokens with training counts c."""
        return np.where(c > 0, self.discounts[0].discounted(c) / max(self.tokens, 1), self.unknown)


def _counts(g: Grams, rows: pd.DataFrame, order: int):
    """By level: distinct n-grams' answers, a place of each, and the counts of all tokens' n-grams."""
    for k in range(order):
        blobs = rows[(rows["kind"] == 0) & (rows["level"] == k)].sort_values("part")["blob"]
        answer = np.concatenate([_unpack(b, np.uint64) for b in blobs])
        _, place, at = np.unique(g.grams[k], return_index=True, return_inverse=True)
        yield answer, place, (answer >> np.uint64(1)).astype(np.int64)[at]


def _shares(model: Model, parts: int, order: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"part": [], "level": [], "block": [], "keys": [], "num": [], "low": []}
        if not len(left):
            return pd.DataFrame(out)
        block = left["block"].iat[0]
        g = Grams(left["text"].tolist(), order)
        lower, count = None, None
        for k, (answer, place, c) in enumerate(_counts(g, right, order)):
            if k:
                of_context = g.shifted(count, model.texts)
                own = place[(answer & np.uint64(1)) == 1]
                keys, at = np.unique(g.contexts[k][own], return_inverse=True)
                num = np.bincount(at, model.discounts[k].discounted(c[own]) / of_context[own], len(keys))
                low = np.bincount(at, lower[own], len(keys))
                asked = np.unique(g.contexts[k][(c == 0) & (of_context > 0)])
                for keys_, num_, low_ in ((keys, num, low), (asked, None, None)):
                    cuts = _cuts(keys_, parts)
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        a, b = cuts[p], cuts[p + 1]
                        packed = (None, None) if num_ is None else (_pack(num_[a:b]), _pack(low_[a:b]))
                        for name, v in zip(out, (p, k, block, _pack_keys(keys_[a:b]), *packed)):
                            out[name].append(v)
                lower = model.discounts[k].discounted(c) / np.maximum(of_context, 1)
            else:
                lower = model.first(c)
            count = c
        return pd.DataFrame(out)

    return run


def _weights(order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["part"].iat[0]), []
        for k in range(1, order):
            rows = pdf[pdf["level"] == k]
            given, asked = rows[rows["num"].notna()].sort_values("block"), rows[rows["num"].isna()]
            if not len(asked):
                continue
            keys, at = np.unique(np.concatenate([_unpack_keys(x) for x in given["keys"]]), return_inverse=True)
            num, low = (np.bincount(at, np.concatenate([_unpack(x, np.float64) for x in given[c]]), len(keys)) for c in ("num", "low"))
            alpha = (1 - num) / (1 - low)
            for block, blob in zip(asked["block"].tolist(), asked["keys"]):
                out.append((block, k, part, _pack(alpha[np.searchsorted(keys, _unpack_keys(blob))])))
        return pd.DataFrame(out, columns=["block", "level", "part", "blob"])

    return run


def _scores(model: Model, order: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")})
        g = Grams(left["text"].tolist(), order)
        p, count, first = None, None, None
        for k, (_, _, c) in enumerate(_counts(g, right, order)):
            if k == 0:
                p, first = np.log10(model.first(c)), c
            else:
                of_context = g.shifted(count, model.texts)
                seen, back = c > 0, (c == 0) & (of_context > 0)
                blobs = right[(right["kind"] == 1) & (right["level"] == k)].sort_values("part")["blob"]
                alpha = np.concatenate([np.empty(0), *(_unpack(b, np.float64) for b in blobs)])
                p[back] += np.log10(alpha[np.unique(g.contexts[k][back], return_inverse=True)[1]])
                p[seen] = np.log10(model.discounts[k].discounted(c[seen]) / of_context[seen])
            count = c
        base = np.log10((first + 1) / (model.tokens + (model.distinct + 1)))
        total = lambda x: np.add.reduceat(x, g.starts)
        return pd.DataFrame({"doc_id": left["doc_id"].array, "train": left["train"].to_numpy(), "n_tokens": g.sizes, "n_known": total((first > 0).astype(np.int64)), "base_score": total(base), "score": total(p)})

    return run


def katz_scores(docs: DataFrame, training: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``;
    the model learns from the rows for which ``training`` holds (null: not). A null or empty text is the end alone.
    An empty table gives an empty result; without training rows every token is the unknown word."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("train"))
    splits = max(1, rows.rdd.getNumPartitions())
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    each = max(1, -(-split_bytes // block_bytes))
    blocks, name = splits * each, f"katz_{uuid.uuid4().hex}"
    block = (F.spark_partition_id() * each + F.pmod(F.xxhash64("doc_id", "text"), F.lit(each))).cast("int")
    buckets, parts = min(blocks, BUCKETS), min(blocks, PARTITIONS)
    rows.withColumn("block", block).write.option("path", f"{scratch.base}/blocks").bucketBy(buckets, "block").saveAsTable(name)
    try:
        laid = spark.table(name)
        if laid.isEmpty():
            return scratch.write(rows.selectExpr("doc_id", "train", "0L n_tokens", "0L n_known", "0L train_tokens", "0D base_score", "0D score"), "scores")
        grouped = laid.groupBy("block")
        asked = grouped.applyInPandas(_requests(parts, order), "part int, level int, block int, keys binary, counts binary")
        answers = scratch.write(asked.groupBy("part").applyInPandas(_answers(order), "block int, level int, part int, blob binary"), "answers")
        levels = [np.zeros(TOP + 3, np.int64) for _ in range(order)]
        for r in answers.where("block = -1").select("level", "blob").toLocalIterator():  # eight numbers a partition
            levels[r["level"]] += np.frombuffer(r["blob"], np.int64)
        model = Model(levels, laid.where("train").count())
        told = answers.where("block >= 0").withColumn("kind", F.lit(0))
        shares = grouped.cogroup(told.groupBy("block")).applyInPandas(_shares(model, parts, order), "part int, level int, block int, keys binary, num binary, low binary")
        weights = scratch.write(shares.groupBy("part").applyInPandas(_weights(order), "block int, level int, part int, blob binary"), "weights")
        told = told.unionByName(weights.withColumn("kind", F.lit(1)))
        schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
        scores = scratch.write(grouped.cogroup(told.groupBy("block")).applyInPandas(_scores(model, order), schema), "scores")
        scratch.drop(answers, weights)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.discard(f"{scratch.base}/blocks")
    return scores.select("doc_id", "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    scored = katz_scores(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
