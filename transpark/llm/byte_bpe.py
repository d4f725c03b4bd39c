"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the split pattern is merged separately: again and again the adjacent pair of least rank
(the leftmost of equal ones) becomes one token. The pre-tokens of a batch stand in one linked list of
byte positions. The queue has a bucket of positions for every merge rank; three levels of 64-bit
bitmaps say which buckets are filled, so that the next rank is found by three find-first-set steps
however many pairs there are. Entries whose pair has changed meanwhile are stale and skipped. A bucket
is merged at once (every other position of an overlapping run), except for ranks whose merge can
create a pair of lower rank: of those only the leftmost one of each pre-token is merged before the
queue is asked again. The work of a pre-token of n bytes is so O(n log n) at most, not O(n^2).

A null text counts as empty and has no tokens.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import map_batches, table, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.iinfo(np.int32).max  # the rank of a pair that does not merge
MEMO_ENTRIES = 400_000  # pre-tokens a worker remembers
MEMO_LENGTH = 48  # characters up to which it remembers one


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaf = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.root = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.root |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            self.push(rank, group)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank with entries, and its positions in order."""
        if not self.root:
            return None
        top = (self.root & -self.root).bit_length() - 1
        mid = self.mid[top]
        block = top << 6 | (mid & -mid).bit_length() - 1
        leaf = self.leaf[block]
        rank = block << 6 | (leaf & -leaf).bit_length() - 1
        self.leaf[block] &= leaf - 1
        if not self.leaf[block]:
            self.mid[top] &= mid - 1
            if not self.mid[top]:
                self.root &= self.root - 1
        found = self.buckets.pop(rank)
        return rank, np.unique(found[0] if len(found) == 1 else np.concatenate(found))


class BytePairs:
    """Merge ranks of a vocabulary, its pair table and its decoding table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # a token is settled if no pair with it ranks below it
        least = np.full(self.size, NONE, np.int64)
        for side in (self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF):
            np.minimum.at(least, side, self.pair_ranks)
        self.settled = (least > np.arange(self.size)).tolist()
        names = {rank: token for token, rank in ranks.items()}
        tokens = [names.get(i, b"") for i in range(self.size)]
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = int(sizes.sum())
        if not n:
            return np.empty(0, np.int64), sizes
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(sizes)[sizes > 0] - 1
        after[last] = -1
        before[last[:-1] + 1] = -1
        rank = np.full(n, NONE, np.int32)  # of the pair that begins here; NONE also where a token was swallowed
        alive = np.ones(n, bool)
        queue = RankQueue(self.size)

        def renew(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank[at] = got = self.ranks_of(ids[at], ids[after[at]])
            live = got != NONE
            if live.any():
                queue.push_all(got[live], at[live])

        renew(np.flatnonzero(after >= 0))
        while (entry := queue.pop()) is not None:
            r, at = entry
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if self.settled[r]:
                joined = np.flatnonzero(after[at[:-1]] == at[1:]) + 1  # overlaps the one before
                if len(joined):
                    run_start = np.ones(len(at), bool)
                    run_start[joined] = False
                    head = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            elif len(at) > 1:
                first = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
                if not first.all():
                    queue.push(r, at[~first])
                    at = at[first]
            right = after[at]
            beyond = after[right]
            ids[at], after[at] = r, beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            alive[right] = False
            rank[right] = NONE
            rank[at] = NONE
            left = before[at]
            renew(np.unique(np.concatenate([at, left[left >= 0]])))
        return ids[alive], np.bincount(piece[alive], minlength=len(pieces))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes one after the other, bytes of each group of ``counts`` ids)."""
        size = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        group_ends = ends[np.concatenate([[0], np.cumsum(counts)])]
        return _gather(self.token_bytes, self.token_start[ids], size), np.diff(group_ends)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every slice, one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Encodes texts with a bounded memory of the pre-tokens seen so far."""

    def __init__(self, pairs: BytePairs, pattern: str):
        self.pairs, self.pattern = pairs, regex.compile(pattern)
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        split = [self.pattern.findall(t) for t in batch]
        missing = sorted({p for row in split for p in row if p not in self.codes})
        codes, new = self.codes, {}
        ids, sizes = self.pairs.encode([p.encode("utf-8", "surrogatepass") for p in missing])
        starts = np.cumsum(sizes) - sizes
        # short pre-tokens are remembered while there is room, the others known for this batch only
        keep = [i for i, p in enumerate(missing) if len(p) <= MEMO_LENGTH][: max(0, MEMO_ENTRIES - len(codes))]
        kept = set(keep)
        known = len(self.sizes)
        kept_ids = _gather(ids, starts[keep], sizes[keep]) if keep else ids[:0]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes[keep]) - sizes[keep]]) if keep else self.starts
        self.sizes = np.concatenate([self.sizes, sizes[keep]]) if keep else self.sizes
        self.flat = np.concatenate([self.flat, kept_ids]) if keep else self.flat
        for j, i in enumerate(keep):
            codes[missing[i]] = known + j
        rest = [i for i in range(len(missing)) if i not in kept]
        if rest:
            new = {missing[i]: len(self.sizes) + j for j, i in enumerate(rest)}
            all_flat = np.concatenate([self.flat, ids])
            all_starts = np.concatenate([self.starts, len(self.flat) + starts[rest]])
            all_sizes = np.concatenate([self.sizes, sizes[rest]])
            look = lambda p: codes[p] if p in codes else new[p]
        else:
            all_flat, all_starts, all_sizes, look = self.flat, self.starts, self.sizes, codes.__getitem__
        n = [len(row) for row in split]
        which = np.fromiter((look(p) for row in split for p in row) if rest else map(look, (p for row in split for p in row)), np.int64, sum(n))
        size = all_sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        return _gather(all_flat, all_starts[which], size), np.diff(ends)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary, once per worker."""
    return Encoder(BytePairs(read_ranks(path)), pattern)


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of every text and the bytes that decoding these ids gives."""
    path = ranks_path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path, pattern)
        rows = texts(batch)
        ids, counts = enc.encode(rows)
        data, sizes = enc.pairs.decode(ids, counts)
        ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        decoded = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends(sizes).buffers()[1], pa.py_buffer(data)])
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(ends(counts), pa.array(ids, pa.int32())), "decoded": decoded}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
