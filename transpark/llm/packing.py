"""Best-fit packing of token sequences by bin completion.

Every text is tokenised and ends with ``END``; longer ones are cut into pieces of ``CAPACITY`` tokens
(the first may be shorter). Which sequence a piece goes to depends on lengths alone, and there are at
most ``CAPACITY`` different ones, so the search runs on the histogram of lengths (a count per length,
whatever the number of documents):

* best-fit decreasing gives the incumbent;
* where it does not reach the lower bound, bin completion branches on the fillings around the largest
  remaining length that no other filling dominates (nothing that remains fits beside, no longer piece
  fits in a place, no single piece fits in two places), fullest first, each repeated as often as the
  counts allow; a branch whose waste so far cannot beat the incumbent is pruned. ``NODES`` bounds the
  search; the incumbent stands when it is reached.

Pieces of one length are interchangeable: numbered densely in the order (length, doc_id, piece), each
finds its sequence and place in the table of repeated fillings by a binary search.

The ids are those of the ``tokenizers`` file of the same vocabulary; they are taken from its rank file,
whose encoder gives the same ids several times faster (tests hold both against each other). With ``added``
the strings of that file's added tokens become their ids, as its own call has it; without, they are ordinary
text.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.byte_bpe import read_ranks
from transpark.llm.common import Scratch, map_batches, table, texts
from transpark.operators.numbering import dense_index

CAPACITY = 1024
END = 2
RANKS = "byte_bpe_50k.tiktoken"
JSON = "byte_bpe_50k.json"  # the same vocabulary with its added tokens
NODES = 5_000
BRANCHES = 8  # fillings tried in a node, fullest first

Plan = list[tuple[tuple[int, ...], int]]  # (lengths in a sequence, times)


@cache
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a ``tokenizers`` file, by content. Those that match by context raise."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"added tokens of {path} that are not plain strings")
    return tuple((t["content"], t["id"]) for t in tokens)


@cache
def _encoding(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=dict(added))


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces (null text: ``end`` alone)."""
    path = ranks_path or public_tokenizers.path(RANKS)
    allowed = {content for content, _ in added}

    def run(batch: pa.RecordBatch) -> dict:
        enc = _encoding(path, pattern, added)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            ids = np.append(enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), end).astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for k, v in zip(out, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                    out[k].append(v)
        out["doc_id"], out["piece"] = pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing on a histogram: open sequences of one content are kept as one entry."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room -> content -> how many
    done: dict[tuple[int, ...], int] = {}

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        to = open_.setdefault(room, {}) if room else done
        to[content] = to.get(content, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        rooms = [(r, c) for r in sorted(open_) if r >= length for c in sorted(open_[r])]
        for room, content in rooms:
            if not left:
                break
            have, each = open_[room].pop(content), room // length
            full = min(have, left // each)
            rest = min(each, left - full * each) if full < have else 0
            put(room - each * length, content + (length,) * each, full) if full else None
            put(room - rest * length, content + (length,) * rest, 1) if rest else None
            if have - full - (rest > 0):
                put(room, content, have - full - (rest > 0))
            left -= full * each + rest
        each = capacity // length
        if left // each:
            put(capacity - each * length, (length,) * each, left // each)
        if left % each:
            put(capacity - left % each * length, (length,) * (left % each), 1)
    for room in open_.values():
        for content, n in room.items():
            done[content] = done.get(content, 0) + n
    return sorted(done.items(), reverse=True)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: total length, and lengths over half that exclude each other."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for cut in sorted({k for k in counts if 2 * k <= capacity} | {0}):
        large = sum(n for k, n in counts.items() if k > capacity - cut)
        mid = {k: n for k, n in counts.items() if capacity < 2 * k and k <= capacity - cut}
        small = sum(k * n for k, n in counts.items() if cut <= k and 2 * k <= capacity)
        room = sum((capacity - k) * n for k, n in mid.items())
        best = max(best, large + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(counts: dict[int, int], room: int, limit: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the remaining lengths, fullest first."""
    lengths = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def grow(i: int, space: int, content: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > 40 * limit * limit or len(found) >= 8 * limit:
            return
        fit = next((j for j in range(i, len(lengths)) if lengths[j] <= space and counts[lengths[j]] > content.count(lengths[j])), None)
        if fit is None:
            if not any(k <= space and counts[k] > content.count(k) for k in lengths):
                found.setdefault(tuple(content), space)
            return
        if lengths[fit] <= space:
            grow(fit, space - lengths[fit], [*content, lengths[fit]])
        grow(fit + 1, space, content)

    grow(0, room, [])

    def dominated(content: tuple[int, ...], space: int) -> bool:
        free = [k for k in lengths if counts[k] > content.count(k)]
        ones = any(y < k <= y + space for y in set(content) for k in free)
        pairs = {a + b for i, a in enumerate(content) for b in content[i + 1 :]}
        return ones or any(p <= k <= p + space for p in pairs for k in free)

    kept = [c for c, space in found.items() if not dominated(c, space)] or list(found)
    return sorted(kept, key=lambda c: (found[c], len(c)))[:limit] or [()]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The fullest plan found: best-fit decreasing, improved by branch and bound on completions."""
    counts = {k: n for k, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    size, bound = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    # a frame of the search: (counts left, sequences so far, their plan); depth first, fullest filling first
    stack: list[tuple[dict[int, int], int, Plan]] = [(counts, 0, [])]
    while stack and size > bound and nodes:
        nodes -= 1
        left, used, plan = stack.pop()
        if not left:
            if used < size:
                size, incumbent = used, plan
            continue
        if used + -(-sum(k * n for k, n in left.items()) // capacity) >= size:  # the waste so far is too much
            continue
        largest = max(left)
        around = dict(left)
        around[largest] -= 1
        for filling in reversed(fillings(around, capacity - largest)):
            content = (largest, *filling)
            need = {k: content.count(k) for k in set(content)}
            times = min(left[k] // c for k, c in need.items())
            rest = {k: n - times * need.get(k, 0) for k, n in left.items()}
            stack.append(({k: n for k, n in rest.items() if n}, used + times, [*plan, (content, times)]))
    return incumbent


def places(plan: Plan, capacity: int = CAPACITY) -> dict[int, dict[str, np.ndarray]]:
    """By length: rank of the first piece, sequences from, pieces per sequence and offset of each run."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, times in plan:
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            runs.setdefault(length, []).append((taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + each * times
            offset += each * length
        sequence += times
    return {k: dict(zip(("rank", "sequence", "each", "offset"), np.array(v, np.int64).T)) for k, v in runs.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length, ...``, lengths from 1 to
    ``capacity``). An empty table gives an empty result; repeated rows are pieces of their own."""
    spark = parts.sparkSession
    scratch = Scratch(spark, "packing")
    parts = scratch.write(parts.drop("sequence_id", "offset", "_rank"), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # a row per length
    where = places(bin_completion(counts, capacity, nodes), capacity)
    below, total = {}, 0
    for length in sorted(counts):
        below[length], total = total, total + counts[length]
    numbered = dense_index(parts, ["length", "doc_id", "piece", "ids_crc32"], name="_rank")

    def run(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(k).to_numpy() for k in ("length", "_rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            rows = np.flatnonzero(length == k)
            r, runs = rank[rows] - below[k], where[k]
            i = np.searchsorted(runs["rank"], r, side="right") - 1
            r = r - runs["rank"][i]
            sequence[rows] = runs["sequence"][i] + r // runs["each"][i]
            offset[rows] = runs["offset"][i] + r % runs["each"][i] * k
        keep = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
        return keep | {"sequence_id": sequence, "offset": offset}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return map_batches(numbered, run, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), added=added_tokens(public_tokenizers.path(JSON))))
