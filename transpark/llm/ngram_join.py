"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the 64-bit hashes of its distinct ``GRAM``-word shingles. Documents with one set
are one class, and classes link when 7 * overlap >= 3 * (size + size), that is Jaccard >= 0.75.

**Points.** The shingles of a set are hashed into groups (the leading bits of the hash), and the counts of
the groups are its point. Sum over groups of the smaller count bounds the overlap of two sets, and the
same sum over the upper corners of two boxes bounds it for all points inside. A set of n shingles has
2n to 4n groups (a power of two); linked sets are at most one power apart, and the finer point is folded.
Boxes hold points folded eightfold, pairs of points are compared unfolded, where the bound is close.

**Blocks.** An R-tree over all points would compare everything with everything, as unrelated texts lie
equally far apart. So points are first dealt to blocks that lose no link: by one global order of shingles,
rare ones first, linked sets share one within the first n - ceil(6n/7) + 1 of the smaller and the first
n - ceil(3n/4) + 1 of the larger set. The order comes from a count sketch of fixed size; whatever its
errors are, it is one order, so they cost time only. Blocks with the same members are one block. Shingles
that the sketch shows as frequent skip the grouping by shingle; large blocks are split into chunks, which
meet each other pairwise.

**Rounds.** Components are wanted, so a pair that is already connected needs no comparison: boxes that
hold one component alone are skipped. Round 1 proposes, in blocks of more than a leaf, for every point the
best smaller one in a random leaf; round 2 a spanning forest of each block's R-tree join, best pairs first;
round 3 every pair of points of different components that the bound lets through, in the blocks where
round 2 found any (in the others no pair is left to look at). Proposals are verified with the whole sets,
taken from the texts again; the next round starts from the components of what was verified.

Without words or text a set is empty, links with nothing, and the document is its own component. Rows
without doc_id take part, but never name a component; such a row alone has a null component.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import Scratch, as_long, mix64, small_batches, table, texts, word_hashes, words
from transpark.llm.components import connected_components

GRAM = 5
SLOTS = 20  # bits of the count sketch: 2^20 counters, 1 MB where it is used
HOT = 8192  # occurrences over the sketch's median from which a shingle's block is split
CHUNK = 4096  # members of one side of a block, and
CHUNK_SHINGLES = 1 << 22  # their shingles
FOLD = 3  # powers of two between the groups of points and of boxes
CACHE = 64 << 20  # bytes of unpacked points that a block keeps
LEAF = 32
FAN = 8
BUCKET_ROWS = 500_000  # shingles of one task that looks for shared ones
FLUSH_ROWS = 2_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer than ``gram`` words are one shingle."""
    w = word_hashes(words(text))
    if not len(w):
        return w
    if len(w) < gram:
        return mix64((w * _ODD[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    total = np.zeros(len(w) - gram + 1, np.uint64)
    for k in range(gram):
        total += w[k : len(w) - gram + 1 + k] * _ODD[k % len(_ODD)]
    return np.unique(mix64(total))


def set_id(s: np.ndarray) -> int:
    """An even signed long that stands for the whole set."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63) & ~1


def level(n):
    """log2 of the groups of a set with n shingles."""
    return np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 2) + 1


def point(s: np.ndarray) -> bytes:
    """The counts of the groups, compressed: as four-bit numbers if they are below 16, else in two bytes."""
    bits = int(level(np.array([len(s)]))[0])
    counts = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype(np.uint16)
    if counts.max(initial=0) < 16:
        counts = (counts[0::2] | counts[1::2] << 4).astype(np.uint8)
    return zlib.compress(counts.tobytes(), 1)


def unpacked(packed: bytes, groups: int) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(packed), np.uint8)
    if len(data) == 2 * groups:
        return data.view(np.uint16)
    return np.stack([data & 15, data >> 4], 1).ravel().astype(np.uint16)


# --- pass 1: sets, points, sketch ------------------------------------------------------------------


def _distinct_sets(it: Iterator[pa.RecordBatch]):
    """(doc_id, text position, set, whether it is the task's first one like it) of every row."""
    seen: set[int] = set()
    for batch in it:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            s = shingles(text)
            sid = set_id(s) if len(s) else None
            new = sid is not None and sid not in seen
            if new:
                seen.add(sid)
            yield doc_id, s, sid, new


def _profile(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOTS, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("point", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    rows: list[tuple] = []
    for doc_id, s, sid, new in _distinct_sets(it):
        if new:
            np.add.at(counts, (s >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
        rows.append((doc_id, sid, len(s), point(s) if new else None, None, None))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    step = 1 << SLOTS - 4
    rows += [(None, None, None, None, b, zlib.compress(counts[b * step : (b + 1) * step].astype(np.int32).tobytes(), 1)) for b in range(16) if counts.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64) for c in pdf["counts"])
    return pd.DataFrame({"block": [pdf["block"].iat[0]], "counts": [total.tobytes()]})


def _sketch(profile: DataFrame) -> np.ndarray:
    """The counters of all tasks together: 16 rows of a fixed size."""
    out = np.zeros(1 << SLOTS, np.int64)
    step = 1 << SLOTS - 4
    for r in profile.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_summed, "block int, counts binary").collect():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out


# --- pass 2: blocks of sets that share a leading shingle -------------------------------------------


def prefix_lengths(n: int) -> tuple[int, int]:
    """Leading shingles that matter where the set is the smaller one, and where it is the larger one."""
    return n - -(-6 * n // 7) + 1, n - -(-3 * n // 4) + 1


def _pack(tokens: np.ndarray, sids: np.ndarray) -> bytes:
    order = np.argsort(tokens)
    steps = np.diff(tokens[order], prepend=np.uint64(0))
    turned = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)  # the high bytes of steps are mostly 0
    return zlib.compress(turned.tobytes(), 1) + sids[order].tobytes() + len(tokens).to_bytes(8, "little")


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[-8:], "little")
    sids = np.frombuffer(blob[-8 - 8 * n : -8], np.int64)
    turned = np.frombuffer(zlib.decompress(blob[: -8 - 8 * n]), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(turned.T).view(np.uint64).ravel(), dtype=np.uint64), sids


def _leading(ranks: np.ndarray, hot: np.ndarray, buckets: int):
    """Blobs of (shingle, set id with bit 0: leading where the set is the smaller one), by shingle range;
    hot shingles go to bags (negative buckets) that belong to no range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            t, s = np.concatenate(tokens), np.concatenate(sids)
            is_hot = hot[(t >> np.uint64(64 - SLOTS)).astype(np.int64)]
            bag = -1 - int(mix64(s[:1].view(np.uint64))[0] >> np.uint64(34))  # another one for every blob
            bucket = np.where(is_hot, bag, ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            t, s, bucket = t[order], s[order], bucket[order]
            keys, first = np.unique(bucket, return_index=True)
            parts = zip(np.split(t, first[1:]), np.split(s, first[1:]))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(keys, pa.int64()), "blob": pa.array([_pack(a, b) for a, b in parts], pa.binary())})

        for _, s, sid, new in _distinct_sets(it):
            if not new:
                continue
            small, large = prefix_lengths(len(s))
            order = np.lexsort((s, ranks[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]))[:large]
            tokens.append(s[order])
            sids.append(sid + (np.arange(large) < small))
            held += large
            if held >= FLUSH_ROWS:
                yield flush()
                tokens, sids, held = [], [], 0
        if held:
            yield flush()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """``g, sid, small`` of the shingles of a bucket that several sets share; the name ``g`` of a block is
    a hash of its members."""
    got = [_unpack(b) for b in pdf["blob"]]
    t, s = (np.concatenate(x) for x in zip(*got))
    if pdf["bucket"].iat[0] < 0:
        return pd.DataFrame({"g": as_long(mix64(t)), "sid": s & ~1, "small": (s & 1).astype(bool)})
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])  # copies in several tasks
    t, s = t[new], s[new]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    sizes = np.diff(np.append(starts, len(t)))
    smalls = np.add.reduceat(s & 1, starts)
    keep = np.repeat((sizes > 1) & (smalls > 0), sizes)
    if not keep.any():
        return pd.DataFrame({"g": np.empty(0, np.int64), "sid": np.empty(0, np.int64), "small": np.empty(0, bool)})
    t, s = t[keep], s[keep]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    sizes = np.diff(np.append(starts, len(t)))
    # an order-free hash of the members: they are sorted, but sums are cheaper than digests
    h = mix64(s.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    name = mix64(np.add.reduceat(h, starts) * _ODD[0] + np.bitwise_xor.reduceat(mix64(h), starts) + sizes.astype(np.uint64))
    return pd.DataFrame({"g": as_long(np.repeat(name, sizes)), "sid": s & ~1, "small": (s & 1).astype(bool)})


# --- R-trees ---------------------------------------------------------------------------------------


class Tree:
    """A packed R-tree over count vectors: leaves of ``LEAF`` points in order of size and of the coarsest
    counts, nodes of ``FAN`` children; boxes keep the upper corner, the range of sizes and of components."""

    def __init__(self, x: np.ndarray, n: np.ndarray, comp: np.ndarray, index: np.ndarray):
        half = x.reshape(len(x), 4, -1).sum(2)
        order = np.lexsort((*half.T, n))
        self.x, self.n, self.comp, self.index = x[order], n[order], comp[order], index[order]
        self.levels = []  # from the leaves up: (upper corner, least n, most n, least component, most component)
        box, width = (self.x, self.n, self.n, self.comp, self.comp), LEAF
        while True:
            at = np.arange(0, len(box[0]), width)
            box = tuple(f.reduceat(v, at, axis=0) for f, v in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), box))
            self.levels.append(box)
            if len(at) == 1:
                break
            width = FAN


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether boxes i of a and j of b may hold a link between different components."""
    ok = (4 * a[2][i] >= 3 * b[1][j]) & (4 * b[2][j] >= 3 * a[1][i])
    ok &= ~((a[3][i] == a[4][i]) & (b[3][j] == b[4][j]) & (a[3][i] == b[3][j]))
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 4096):
        part = at[k : k + 4096]
        bound = np.minimum(a[0][i[part]], b[0][j[part]]).sum(1, dtype=np.int64)
        ok[part] = 7 * bound >= 3 * (a[1][i[part]] + b[1][j[part]])
    return ok


def _children(i: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in i, child) of every child of the boxes i on a level of n entries."""
    grid = i[:, None] * width + np.arange(width)
    at, k = np.nonzero(grid < n)
    return at, grid[at, k]


def tree_join(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of points that the bound lets through, once each if ``a is b``; in portions."""
    depth = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    pa_, pb_ = (a.x, a.n, a.n, a.comp, a.comp), (b.x, b.n, b.n, b.comp, b.comp)
    while depth:
        la, lb, i, j = depth.pop()
        if len(i) > 256:  # portions bound the memory of a step
            cut = len(i) // 2
            depth += [(la, lb, i[:cut], j[:cut]), (la, lb, i[cut:], j[cut:])]
            continue
        boxes_a, boxes_b = a.levels[la] if la >= 0 else pa_, b.levels[lb] if lb >= 0 else pb_
        ok = _possible(boxes_a, boxes_b, i, j)
        if a is b:
            ok &= i <= j if la >= 0 else i < j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la < 0 and lb < 0:
            yield a.index[i], b.index[j]
            continue
        if la >= lb and la >= 0:
            at, child = _children(i, LEAF if la == 0 else FAN, len(a.levels[la - 1][0]) if la else len(a.x))
            i, j, la = child, j[at], la - 1
        if (lb > la and lb >= 0) if a is not b else True:
            at, child = _children(j, LEAF if lb == 0 else FAN, len(b.levels[lb - 1][0]) if lb else len(b.x))
            i, j, lb = i[at], child, lb - 1
        depth.append((la, lb, i, j))


class Block:
    """The points of one block (or of two of its chunks)."""

    def __init__(self, rows: dict[str, np.ndarray], points: list[bytes]):
        self.sid, self.n, self.small, self.comp, self.side = (rows[k] for k in ("sid", "n", "small", "comp", "side"))
        self.level = level(self.n)
        self.raw, self.unpacked, self.room = points, {}, CACHE

    def counts(self, k: int) -> np.ndarray:
        got = self.unpacked.get(k)
        if got is None:
            got = unpacked(self.raw[k], 1 << int(self.level[k]))
            if self.room > got.nbytes:
                self.unpacked[k] = got
                self.room -= got.nbytes
        return got

    def matrix(self, index: np.ndarray, bits: int) -> np.ndarray:
        """Counts of the points ``index`` in 2^bits groups."""
        out = np.empty((len(index), 1 << bits), np.uint16)
        for row, k in enumerate(index.tolist()):
            out[row] = self.counts(k).reshape(1 << bits, -1).sum(1, dtype=np.uint16)
        return out

    def score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bound of the Jaccard similarity of pairs, 0 where it rules a link out."""
        out = np.zeros(len(i))
        lo, hi = np.minimum(self.level[i], self.level[j]), np.maximum(self.level[i], self.level[j])
        sizes = (4 * self.n[i] >= 3 * self.n[j]) & (4 * self.n[j] >= 3 * self.n[i]) & (hi - lo <= 1)
        for bits in np.unique(lo[sizes]):
            at = np.flatnonzero(sizes & (lo == bits))
            step = max(16, (1 << 21) >> int(bits))  # bounds the memory of a step
            for k in range(0, len(at), step):
                part = at[k : k + step]
                used, back = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
                x = self.matrix(used, int(bits))
                most = np.minimum(x[back[: len(part)]], x[back[len(part) :]]).sum(1, dtype=np.int64)
                total = self.n[i[part]] + self.n[j[part]]
                out[part] = np.where(7 * most >= 3 * total, most / np.maximum(total - most, 1), 0)
        return out

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of different components for which this block answers."""
        smaller = np.where(self.n[i] < self.n[j], self.small[i], np.where(self.n[i] > self.n[j], self.small[j], self.small[i] | self.small[j]))
        return smaller & (self.comp[i] != self.comp[j])

    def joined(self, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the R-tree join and their bounds; across the sides only if there are two."""
        for bits in np.unique(self.level):
            for d in (0, 1):
                fine = np.flatnonzero(self.level == bits + d)
                own = np.flatnonzero(self.level == bits)
                if not len(fine):
                    continue
                for p, q in (((0, 1), (1, 0)) if d else ((0, 1),)) if two else ((None, None),):
                    left = own if p is None else own[self.side[own] == p]
                    right = fine if q is None else fine[self.side[fine] == q]
                    if not len(left) or not len(right):
                        continue
                    box = max(2, int(bits) - FOLD)
                    a = Tree(self.matrix(left, box), self.n[left], self.comp[left], left)
                    b = a if p is None and not d else Tree(self.matrix(right, box), self.n[right], self.comp[right], right)
                    for i, j in tree_join(a, b):
                        ok = self.allowed(i, j)
                        score = self.score(i[ok], j[ok])
                        yield i[ok][score > 0], j[ok][score > 0], score[score > 0]


def _by_leaf(block: Block, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Round 1: every point and the one with the highest bound among those with smaller set ids in its
    (random) leaf."""
    order = np.argsort(mix64(block.sid.view(np.uint64) ^ np.uint64(g % 2**64)))
    left, right = [], []
    for k in range(0, len(order), LEAF):
        leaf = order[k : k + LEAF]
        leaf = leaf[np.argsort(block.sid[leaf])]
        u, v = np.triu_indices(len(leaf), 1)
        i, j = leaf[u], leaf[v]
        ok = block.allowed(i, j)
        i, j = i[ok], j[ok]
        score = block.score(i, j)
        i, j, score = i[score > 0], j[score > 0], score[score > 0]
        best = np.lexsort((i, -score, j))  # j has the larger set id
        best = best[np.unique(j[best], return_index=True)[1]]
        left.append(i[best])
        right.append(j[best])
    return np.concatenate(left), np.concatenate(right)


def _spanning(block: Block, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Round 2: a forest of pairs that the bound lets through, from one component to another."""
    comps, label = np.unique(block.comp, return_inverse=True)
    root = np.arange(len(comps))
    pairs = []
    for i, j, score in block.joined(two):
        while not np.array_equal(root, root[root]):
            root = root[root]
        a, b = root[label[i]], root[label[j]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((-score, hi, lo))
        order = order[lo[order] != hi[order]]
        if not len(order):
            continue
        first = np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])])
        order = order[first]  # the best pair of any two components
        for k in order[np.argsort(-score[order], kind="stable")].tolist():
            x, y = int(lo[k]), int(hi[k])
            while root[x] != x:
                x = int(root[x])
            while root[y] != y:
                y = int(root[y])
            if x != y:
                root[max(x, y)] = min(x, y)
                pairs.append((i[k], j[k]))
    out = np.array(pairs, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _proposals(round_: int):
    """Pairs ``a < b`` from the rows of blocks, which come sorted by (g, i, j)."""

    def pairs_of(key: tuple, rows: dict[str, np.ndarray], points: list[bytes]) -> Iterator[pa.RecordBatch]:
        g, i_, j_ = key
        block = Block(rows | {"side": (rows["chunk"] != i_).astype(np.int64)}, points)
        two = i_ != j_
        if round_ == 1:
            found = [_by_leaf(block, g)]
        elif round_ == 2:
            found = [_spanning(block, two)]
        else:
            found = ((i, j) for i, j, _ in block.joined(two))
        for i, j in found:
            if len(i):
                a, b = block.sid[i], block.sid[j]
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(a), g), pa.int64()), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("sid", "n", "small", "comp", "chunk")
        key, held, points = None, [], []
        for batch in it:
            keys = np.stack([batch.column(k).to_numpy() for k in ("g", "i", "j")], 1)
            data = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in columns}
            raw = batch.column("point").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(keys[a].tolist())
                if now != key and held:
                    yield from pairs_of(key, {k: np.concatenate([h[k] for h in held]) for k in columns}, points)
                    held, points = [], []
                key = now
                held.append({k: v[a:b] for k, v in data.items()})
                points.extend(raw[a:b])
        if held:
            yield from pairs_of(key, {k: np.concatenate([h[k] for h in held]) for k in columns}, points)

    return run


# --- verification ----------------------------------------------------------------------------------


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (2^SLOTS bits) of the hashed ids; it only spares rows that nothing asks for."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SLOTS, bool)
        for batch in it:
            bits[_slot(batch.column("doc_id"))] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"bits": [zlib.compress(total.tobytes(), 1)]})

    parts = ids.mapInArrow(run, "bits binary").withColumn("k", F.pmod(F.xxhash64("bits"), F.lit(32)))
    out = np.zeros(1 << SLOTS - 3, np.uint8)
    for r in parts.groupBy("k").applyInPandas(either, "bits binary").collect():  # at most 32 rows of a fixed size
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return np.unpackbits(out).astype(bool)


def _slot(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets link. A set is read again from the text of one document that has it."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = _filter(classes.join(asked, "sid").where("doc_id is not null").select("doc_id"))

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def needed() -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids = batch.column("doc_id")
                yield batch.filter(pa.array(wanted[_slot(ids.fill_null(0))] | ids.is_null().to_numpy(zero_copy_only=False)))

        rows: list[tuple] = []
        size = 0
        for _, s, sid, new in _distinct_sets(needed()):
            if new:
                rows.append((sid, s.tobytes()))
                size += 8 * len(s)
            if size > 1 << 24:
                yield pa.RecordBatch.from_pydict({"sid": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([r[1] for r in rows], pa.binary())})
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({"sid": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([r[1] for r in rows], pa.binary())})

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    found = docs.mapInArrow(sets, "sid long, s binary").join(asked, "sid", "left_semi").dropDuplicates(["sid"])
    left = pairs.join(found.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(found.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    profile = scratch.write(docs.mapInArrow(_profile, "doc_id long, sid long, n long, point binary, block int, counts binary"), "profile")
    sets = profile.where("block is null")
    classes = scratch.write(sets.where("point is not null").groupBy("sid").agg(F.min("n").alias("n"), F.min("point").alias("point"), F.min("doc_id").alias("doc_id")), "classes")
    counts = _sketch(profile)
    ranks = np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)
    hot = counts > np.median(counts) + HOT
    buckets = max(1, -(-int(classes.agg(F.sum("n")).first()[0] or 0) // (4 * BUCKET_ROWS)))

    blobs = docs.mapInArrow(_leading(ranks, hot, buckets), "bucket long, blob binary")
    shared = blobs.groupBy("bucket").applyInPandas(_shared, "g long, sid long, small boolean")
    members = scratch.write(shared.groupBy("g", "sid").agg(F.max("small").alias("small")), "members")

    component = classes.select("sid", "n", F.col("sid").alias("comp"))
    forest, labels, used = None, None, [members]
    for round_ in (1, 2, 3):
        rows = members.join(component, "sid")
        chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
        several = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), chunks.alias("chunks"))
        several = several.where((F.col("lo") != F.col("hi")) & (F.col("m") > (LEAF if round_ == 1 else 1))).select("g", "chunks")
        if round_ == 3:
            several = several.join(pairs.select("g").distinct(), "g", "left_semi")
        rows = rows.join(several, "g").withColumn("chunk", F.pmod(F.xxhash64("sid", "g"), F.col("chunks")).cast("int"))
        others = F.array("chunk") if round_ == 1 else F.sequence(F.lit(0), F.col("chunks") - 1)
        rows = rows.withColumn("other", F.explode(others)).select("g", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "sid", "small", "comp")
        rows = rows.join(classes.select("sid", "n", "point"), "sid").repartition(partitions, "g", "i", "j").sortWithinPartitions("g", "i", "j", "sid")
        pairs = rows.select("g", "i", "j", "chunk", "sid", "small", "comp", "n", "point").mapInArrow(_proposals(round_), "g long, a long, b long")
        if round_ == 1:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a"))  # one smaller neighbour each
        pairs = scratch.write(pairs, f"pairs{round_}")
        links = _verified(docs, classes, pairs.select("a", "b").distinct())
        links = scratch.write(links if forest is None else links.union(forest), f"links{round_}")
        used += [pairs, links] if labels is None else [pairs, links, labels]
        labels = scratch.write(connected_components(links, scratch), f"labels{round_}")
        forest = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
        component = classes.select("sid", "n").join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "n", F.coalesce("component", "sid").alias("comp"))

    scratch.drop(*used)
    named = sets.select("doc_id", "sid", "n").join(component.select("sid", "comp"), "sid", "left")
    names = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("name"))
    out = named.join(names, "comp", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
