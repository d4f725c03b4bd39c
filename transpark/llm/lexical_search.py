"""Ranked lexical search: MaxScore over blocks of documents, with bounds of term pairs.

A text's terms are its words of letters and digits (everything beyond ASCII included), A-Z lower-cased. With N
documents that hold a term, L terms in all, a document of n terms and m = 10 + (90*n*N) div L, a term of
weight w = floor(1000*ln((2*N+2)/(2*df+1))) that occurs tf times adds w*((10^9*tf) div (1000*tf+8*m)); an item's
terms count once each.

The index has one row for a block of at most some ``BLOCK_DOCS`` documents: the postings of the terms that the
items ask for, sorted by term. Once N, L and the weights are known, every block gets its term maxima, and for
the term pairs of the items (neighbours in order of weight) the intersection list of both postings with the
largest joint impact in it.

A block is searched for an item as in MaxScore: terms in ascending order of their maxima, and a threshold that
is the k-th best score so far. A chosen set of disjoint pairs, those that save most, tightens the bounds: two
terms add at most the larger of their maxima to a document outside their intersection list, and at most the
larger of that and the joint maximum to one inside. Terms whose combined bound stays below the threshold are
not essential: candidates come from the postings of the other terms and from the intersection lists of pairs
of inessential terms. Candidates are completed term by term and leave as soon as their bound does. Items are
first searched in one block of ``SEED_SHARE``, whose k-th scores are thresholds for all tasks. All bounds are
upper bounds and ties are completed, so the result is exact.

Postings never move between tasks; only term counts and each task's best k do. Items whose terms are more than
``QUERY_TERMS`` in all are searched in several passes, so that what every task holds of them is bounded.

Null and empty texts have no terms: such documents are not counted, such items get no rows. Rows with one
item_id (or none) are one item of all their terms. Repeated documents are documents of their own; null ids
come last among equal scores. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transpark.llm.arrow_words import split_words
from transpark.llm.common import Scratch, map_batches, small_batches, table

BLOCK_DOCS = 8192  # of a block, give or take one Arrow batch
BLOCK_POSTINGS = 4_000_000  # a block ends after as many, too
QUERY_TERMS = 2_000_000  # (item, term) pairs searched in one pass, on average
SEED_SHARE = 16  # of the blocks, one in as many gives the first thresholds

_POSTINGS = "block long, n_docs long, n_terms long, ids binary, null_ids binary, lengths binary, terms binary, starts binary, places binary, tfs binary"
_BLOCKS = "block long, ids binary, null_ids binary, terms binary, starts binary, places binary, q binary, max_q binary, pairs binary, joint binary, pair_starts binary, pair_places binary"
_KINDS = {"null_ids": np.bool_, "starts": np.int32, "terms": np.int32, "places": np.int32, "tfs": np.int32, "q": np.int32, "max_q": np.int32, "pairs": np.int32, "pair_starts": np.int32, "pair_places": np.int32}


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), _KINDS.get(name, np.int64))


def _row(**columns) -> pa.RecordBatch:
    """One row; arrays as bytes."""
    made = {k: np.ascontiguousarray(v, _KINDS.get(k, np.int64)).tobytes() if isinstance(v, np.ndarray) else v for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in made.items()})


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct ``item_id, term`` of items (``item_id, text``)."""

    def run(batch: pa.RecordBatch) -> dict:
        vocabulary, codes, rows = split_words(batch.column("text"))
        pairs = np.unique(rows * len(vocabulary) + codes)
        of = pairs // max(len(vocabulary), 1)
        return {"item_id": batch.column("item_id").take(pa.array(of)), "term": vocabulary.take(pa.array(pairs - of * len(vocabulary)))}

    return map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, term string").distinct()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row for a block of documents: the postings of ``terms``, by their place in the list."""
    small_batches(docs.sparkSession)
    place_of = {t: i for i, t in enumerate(terms)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, n, n_postings = [], [], [], 0, 0
        block = TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            doc, term, tf = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((doc, term))
            every, starts = np.unique(term[order], return_index=True)
            id_ = pa.chunked_array(ids).combine_chunks()
            length = np.concatenate(lengths)
            return _row(
                block=block, n_docs=int(np.count_nonzero(length)), n_terms=int(length.sum()),
                ids=id_.fill_null(2**63 - 1).to_numpy(), null_ids=id_.is_null().to_numpy(zero_copy_only=False), lengths=length,
                terms=every, starts=np.append(starts, len(order)), places=doc[order], tfs=tf[order],
            )

        for batch in it:
            vocabulary, codes, rows = split_words(batch.column("text"))
            asked = np.fromiter((place_of.get(w, -1) for w in vocabulary.to_pylist()), np.int64, len(vocabulary))
            term = asked[codes]
            there = term >= 0
            key, tf = np.unique(rows[there] * len(terms) + term[there], return_counts=True)
            found.append((key // max(len(terms), 1) + n, key % max(len(terms), 1), tf))
            ids.append(batch.column("doc_id"))
            lengths.append(np.bincount(rows, minlength=batch.num_rows))
            n, n_postings = n + batch.num_rows, n_postings + len(key)
            if n >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                yield flush()
                ids, lengths, found, n, n_postings, block = [], [], [], 0, 0, block + 1
        if n:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


def document_counts(index: DataFrame, n_terms: int) -> DataFrame:
    """``term, df`` over all blocks: every task sums its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in it:
            for i in range(batch.num_rows):
                counts[_array(batch, "terms", i)] += np.diff(_array(batch, "starts", i))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": there.astype(np.int32), "df": counts[there]})

    return index.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Items:
    """Items of one pass: the terms of each, the distinct pairs, and the pairs inside each item."""

    ids: list
    terms: list[np.ndarray]
    pairs: np.ndarray
    pairs_of: list[np.ndarray]

    @classmethod
    def of(cls, asked: dict, weights: np.ndarray) -> Items:
        terms = [np.array(sorted((t for t in ts if weights[t] > 0), key=lambda t: (-weights[t], t)), np.int64) for ts in asked.values()]
        number: dict[tuple[int, int], int] = {}
        own = [[number.setdefault((min(a, b), max(a, b)), len(number)) for a, b in zip(ts[::2].tolist(), ts[1::2].tolist())] for ts in terms]
        return cls(list(asked), terms, np.array(list(number), np.int64).reshape(-1, 2), [np.array(x, np.int64) for x in own])


def _normal_lengths(n: np.ndarray, docs: int, every: int) -> np.ndarray:
    """10 + (90*n*N) div L, beyond 64 bits in Python's integers."""
    if len(n) and int(n.max()) * 90 * docs >= 2**63:
        return np.array([10 + 90 * x * docs // every for x in n.tolist()], np.int64)
    return 10 + 90 * n * docs // max(every, 1)


def with_bounds(index: DataFrame, items: Items, weights: np.ndarray, docs: int, every: int) -> DataFrame:
    """The blocks with impacts in place of counts, the maxima of terms, and the intersection lists of pairs
    with their joint maxima."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                terms, starts, places, tf = (_array(batch, k, i) for k in ("terms", "starts", "places", "tfs"))
                if not len(terms):
                    continue
                m, tf = _normal_lengths(_array(batch, "lengths", i), docs, every), tf.astype(np.int64)
                q = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
                at = np.full(len(weights), -1)
                at[terms] = np.arange(len(terms))
                joint, lists, there = [], [], []
                dense = np.full(len(m), -1, np.int64)  # a document's impact by the pair's first term
                for p in np.flatnonzero((at[items.pairs] >= 0).all(axis=1)).tolist():
                    (a, b), (x, y) = items.pairs[p], at[items.pairs[p]]
                    if starts[y + 1] - starts[y] > starts[x + 1] - starts[x]:
                        (a, b), (x, y) = (b, a), (y, x)
                    small, large = slice(starts[y], starts[y + 1]), slice(starts[x], starts[x + 1])
                    dense[places[large]] = q[large]
                    other = dense[places[small]]
                    both = other >= 0
                    dense[places[large]] = -1
                    there.append(p)
                    lists.append(places[small][both])
                    joint.append(int((weights[a] * other[both] + weights[b] * q[small][both]).max(initial=0)))
                yield _row(
                    block=batch.column("block")[i].as_py(), ids=_array(batch, "ids", i), null_ids=_array(batch, "null_ids", i),
                    terms=terms, starts=starts, places=places, q=q, max_q=np.maximum.reduceat(q, starts[:-1]),
                    pairs=np.array(there, np.int32), joint=np.array(joint, np.int64),
                    pair_starts=np.cumsum([0, *map(len, lists)]), pair_places=np.concatenate([*lists, np.zeros(0, np.int32)]),
                )

    return index.mapInArrow(run, _BLOCKS)


class Block:
    """A block of the index, as its arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_terms: int, n_pairs: int):
        for name in batch.schema.names:
            if name != "block":
                setattr(self, name, _array(batch, name, i))
        self.at = np.full(n_terms, -1)
        self.at[self.terms] = np.arange(len(self.terms))
        self.pair_at = np.full(n_pairs, -1)
        self.pair_at[self.pairs] = np.arange(len(self.pairs))

    def postings(self, x: int) -> slice:
        return slice(self.starts[x], self.starts[x + 1])


def search_block(block: Block, terms: np.ndarray, pairs: np.ndarray, every_pair: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of the block with a score of ``least`` or more (``least`` >= 1)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = terms[block.at[terms] >= 0]
    most = weights[terms] * block.max_q[block.at[terms]]
    order = np.argsort(most, kind="stable")
    terms, most = terms[order], most[order]
    if most.sum() < least:
        return none
    rank = {t: i for i, t in enumerate(terms.tolist())}
    # disjoint pairs, those that save most first
    known = [(block.pair_at[p], *sorted((rank[a], rank[b]))) for p, (a, b) in zip(pairs.tolist(), every_pair[pairs].tolist()) if block.pair_at[p] >= 0]
    saved = sorted(((most[i] + most[j] - max(most[j], block.joint[x]), x, i, j) for x, i, j in known), key=lambda s: (-s[0], s[1]))
    chosen, used = [], set()
    for gain, x, i, j in saved:
        if gain > 0 and i not in used and j not in used:
            used.update((i, j))
            chosen.append((x, i, j))
    apart, together = most.copy(), most.copy()  # the bound of a prefix of terms grows by these
    for x, i, j in chosen:
        apart[j] = most[j] - most[i]
        together[j] = max(most[j], block.joint[x]) - most[i]
    apart, together = np.cumsum(apart), np.cumsum(together)
    if together[-1] < least:
        return none
    # inessential: without another term and outside all intersection lists, a document stays below
    first = int(np.searchsorted(apart, least, "left"))
    inside = [(x, max(0, int(block.joint[x] - most[j]))) for x, i, j in chosen if j < first]
    score = np.zeros(len(block.ids), np.int64)
    for i in range(first, len(terms)):
        of = block.postings(block.at[terms[i]])
        score[block.places[of]] += weights[terms[i]] * block.q[of].astype(np.int64)
    more = np.zeros(len(block.ids), np.int64)
    for x, extra in inside:
        if extra:
            more[block.pair_places[block.pair_starts[x] : block.pair_starts[x + 1]]] += extra
    left = int(apart[first - 1]) if first else 0
    at = np.flatnonzero(((score > 0) | (more > 0)) & (score + more + left >= least))
    for i in range(first - 1, -1, -1):
        at = at[score[at] + together[i] >= least]
        if not len(at):
            return none
        of = block.postings(block.at[terms[i]])
        places, impact = block.places[of], block.q[of]
        if len(at) * 8 < len(places):
            found = np.minimum(np.searchsorted(places, at), len(places) - 1)
            score[at] += np.where(places[found] == at, weights[terms[i]] * impact[found].astype(np.int64), 0)
        else:
            score[places] += weights[terms[i]] * impact.astype(np.int64)
    at = at[score[at] >= least]
    return at, score[at]


def best_in_blocks(blocks: DataFrame, items: Items, weights: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: every task's k best documents of each item, none below ``least``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.bool_), np.zeros(0, np.int64))] * len(items.ids)
        for batch in it:
            for i in range(batch.num_rows):
                block = Block(batch, i, len(weights), len(items.pairs))
                for n, (terms, pairs) in enumerate(zip(items.terms, items.pairs_of)):
                    at, score = search_block(block, terms, pairs, items.pairs, weights, int(floor[n]))
                    if not len(at):
                        continue
                    ids, null_ids, scores = (np.concatenate(x) for x in zip(best[n], (block.ids[at], block.null_ids[at], score)))
                    top = np.lexsort((ids, null_ids, -scores))[:k]
                    best[n] = ids[top], null_ids[top], scores[top]
                    if len(top) == k:
                        floor[n] = max(floor[n], scores[top[-1]])
        ids, null_ids, scores = (np.concatenate(x) for x in zip(*best))
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_pydict({"item": item, "doc_id": pa.array(ids, mask=null_ids), "score": scores})

    return blocks.mapInArrow(run, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; Spark keeps k rows of an item before they move."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(docs: DataFrame, asked: dict, terms: list[str], k: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    index = scratch.write(postings(docs, terms), "postings")
    n, every = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(terms), np.int64)
    w = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1)))
    for r in document_counts(index, len(terms)).select("term", w.alias("w")).collect():
        weights[r["term"]] = r["w"]
    items = Items.of(asked, weights)
    bounded = with_bounds(index, items, weights, n, every).withColumn("seed", F.pmod(F.xxhash64("block"), F.lit(SEED_SHARE)) == 0)
    path = f"{scratch.base}/blocks"
    bounded.write.partitionBy("seed").parquet(path)
    scratch.drop(index)
    blocks = spark.read.schema(bounded.schema).parquet(path)
    columns = [c for c in bounded.columns if c != "seed"]
    least = np.ones(len(asked), np.int64)
    seeds = _best(best_in_blocks(blocks.where("seed").select(*columns), items, weights, k, least), k)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = max(1, r["score"])
    found = _best(best_in_blocks(blocks.select(*columns), items, weights, k, least), k)
    ids = spark.createDataFrame(list(enumerate(asked)), "item int, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents (``doc_id, text``) that score highest for each item
    (``item_id, text``), equal scores by doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.write(item_terms(items), "items")
    passes = max(1, -(-asked.count() // QUERY_TERMS))
    out = []
    for i in range(passes):
        of: dict = {}
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        for r in mine.collect():  # QUERY_TERMS rows on average
            of.setdefault(r["item_id"], set()).add(r["term"])
        terms = sorted(set().union(*of.values()))
        place = {t: j for j, t in enumerate(terms)}
        if terms:
            out.append(_search(docs, {key: {place[t] for t in ts} for key, ts in of.items()}, terms, k, Scratch(spark, f"search-{i}")))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
