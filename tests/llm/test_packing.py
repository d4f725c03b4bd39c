import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from helpers import EDGE, LONG, documents, edge_docs, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transpark.llm.packing import best_fit, bin_completion, fillings, lower_bound, pack, pieces

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def valid(plan, counts, capacity):
    got = {}
    for content, times in plan:
        assert sum(content) <= capacity and times > 0
        for k in content:
            got[k] = got.get(k, 0) + times
    assert got == {k: n for k, n in counts.items() if n}
    return sum(t for _, t in plan)


def fewest(lengths, capacity):
    """Exact bin packing by trying all assignments."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_small_cases_are_optimal(lengths):
    counts = {k: lengths.count(k) for k in set(lengths)}
    used = valid(bin_completion(counts, 20), counts, 20)
    assert lower_bound(counts, 20) <= fewest(lengths, 20) == used <= valid(best_fit(counts, 20), counts, 20)


def test_large_histograms():
    rng = random.Random(2)
    for n, most in ((3000, 1024), (3000, 600), (200, 400)):
        lengths = [rng.randint(1, most) for _ in range(n)]
        counts = {k: lengths.count(k) for k in set(lengths)}
        used = valid(bin_completion(counts), counts, 1024)
        assert used <= valid(best_fit(counts), counts, 1024) and used <= 1.01 * lower_bound(counts) + 1


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 4 sequences of 10; found whatever the first fit does
    assert valid(bin_completion(counts, 10), counts, 10) == 4
    assert all(sum(f) <= 4 for f in fillings(counts, 4)) and (4,) in fillings(counts, 4)


def check(df, rows):
    got = pack(pieces(df)).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(doc_id), i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    rows_of = {}
    for r in got:
        rows_of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows_of.values():  # gapless from 0, within the capacity
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(rows_of) <= 1.02 * lower_bound(counts) + 1


def test_edge_rows(spark):
    check(edge_docs(spark).repartition(3), EDGE)
    assert pack(pieces(no_docs(spark))).count() == 0
    check(edge_docs(spark, [(1, None)] * 3000), [(1, None)] * 3000)


def test_documents(spark):
    df = documents(spark, "0.01")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_exact_multiples(spark):
    ids = TOKENIZER.encode(LONG, add_special_tokens=False)
    text = LONG[: ids.offsets[2046][1]]
    rows = [(i, t) for i, t in enumerate([text, LONG[: ids.offsets[1022][1]], LONG[: ids.offsets[1023][1]], "<|endoftext|>"])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
