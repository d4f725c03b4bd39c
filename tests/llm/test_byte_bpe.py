import hashlib
import random

import public_tokenizers
import tiktoken
from helpers import EDGE, documents, edge_docs, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from transpark.llm.byte_bpe import RANKS, BytePairs, Encoder, RankQueue, encode_documents, encoder, read_ranks

PATH = public_tokenizers.path(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def same(texts):
    enc = encoder(PATH, public_tokenizers.PATTERN)
    ids, counts = enc.encode(texts)
    want = [REFERENCE.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    data, sizes = enc.pairs.decode(ids, counts)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]


def test_long_and_odd_pre_tokens():
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdef") for _ in range(30000))
    same(["a" * 20000, "ab" * 9000, letters, " \t\n\n  x", "it's 'S we'll", "  é漢字😀" * 50, "", " " * 1000, "0123456789" * 500, "<|endoftext|>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_text(texts):
    same(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6))
def test_merges_that_create_lower_ranks(pieces):
    """A vocabulary whose longer tokens rank below their parts."""
    order = [b"aba", b"bab", b"bb", b"ab", b"aa", b"abab", b"aaa", b"abb", b"ba"]
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {t: i for i, t in enumerate(order)}
    ids, counts = BytePairs(ranks).encode([p.encode() for p in pieces])
    want = []
    for p in pieces:
        parts = [bytes([b]) for b in p.encode()]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want.append([ranks[x] for x in parts])
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_queue_order():
    import numpy as np

    queue = RankQueue(50_000)
    for rank in (49_999, 3, 64, 4095, 4096, 3):
        queue.push(rank, np.array([rank]))
    got = []
    while (entry := queue.pop()) is not None:
        got.append(entry[0])
    assert got == [3, 64, 4095, 4096, 49_999]


def test_full_memory(monkeypatch):
    from transpark.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 3)
    enc = Encoder(BytePairs(read_ranks(PATH)), public_tokenizers.PATTERN)
    for texts in (["one two three four five", "one two"], ["six one " + "x" * 100, "seven"]):
        ids, _ = enc.encode(texts)
        assert ids.tolist() == [i for t in texts for i in REFERENCE.encode_ordinary(t)]
    assert len(enc.codes) == 3


def test_documents(spark):
    from transpark.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in documents(spark).collect():
        ids = REFERENCE.encode_ordinary(r.text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256, rows[r.doc_id].decoded_sha256) == (len(ids), digest, hashlib.sha256(r.text.encode()).hexdigest())


def test_edge_rows(spark):
    got = encode_documents(edge_docs(spark)).collect()
    want = sorted((d is None, d or 0, REFERENCE.encode_ordinary(t or "")) for d, t in EDGE)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == want
    assert encode_documents(no_docs(spark)).count() == 0
