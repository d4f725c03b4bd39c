"""Repeated passages that no chunk boundary marks: short lines, inside a physical line, one sentence."""

import random

from helpers import EDGE, documents, edge_docs, no_docs

from transpark.llm.line_dedup import LEAST_WORDS, LONG_LINE, dedup_lines, lines, op9_line_dedup

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))


def op9(spark, rows, tmp):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp}/documents.parquet")
    return {r.doc_id: r for r in op9_line_dedup(spark, str(tmp)).collect()}


def test_passages_go_wherever_they_stand(spark, tmp_path):
    rng = random.Random(5)
    passages = {
        "short lines": "\n".join(words(rng, 11) for _ in range(5)),
        "very short lines": "\n".join(words(rng, n) for n in (5, 10, 3, 12, 4, 9, 8, 3)),
        "inside a line": " ".join(words(rng, n) + "." for n in (14, 9, 17, 12)),
        "long, then short": words(rng, 41) + ".\n" + words(rng, 9) + ".",
        "one sentence": words(rng, 55) + ".",
    }
    rows, own = [], {}
    for k, (name, passage) in enumerate(passages.items()):
        glue = "\n" if "short" in name else " "
        for i in range(20):
            a, b = words(rng, 13) + ".", words(rng, 9) + "."
            own[100 * k + i] = (a, b)
            rows.append((100 * k + i, glue.join([words(rng, 20) + ".", a, passage, b, words(rng, 30) + "."])))
    got = op9(spark, rows, tmp_path)
    for k, passage in enumerate(passages.values()):
        assert got[100 * k].n_removed == 0 and passage in got[100 * k].text
        for i in range(1, 20):
            text = got[100 * k + i].text
            assert not any(w in text for w in passage.replace(".", "").split()), (k, i)
            assert all(o in text for o in own[100 * k + i])


def brute(rows):
    """Lines of repeated runs go, the first occurrence by (doc_id, nulls last) stays."""
    texts = sorted({(d, t) for d, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0))
    parts = {r: [p.strip() for p in lines(r[1])] for r in texts}
    long_enough = lambda x: sum(p.count(b" ") + 1 for p in x) >= LEAST_WORDS and len(x) >= 2
    first, lost = {}, {r: set() for r in texts}
    for r in texts:
        x = parts[r]
        n = len(x)
        spans = {(i, i + 1) for i in range(n) if x[i].count(b" ") + 1 >= LONG_LINE}
        spans |= {(i, next((j for j in range(i + 2, n + 1) if long_enough(x[i:j])), 0)) for i in range(n)}
        spans |= {(next((i for i in range(j - 2, -1, -1) if long_enough(x[i:j])), n), j) for j in range(n + 1)}
        for i, j in sorted(s for s in spans if s[0] < s[1]):
            at, k = first.setdefault(tuple(x[i:j]), (r, i))
            if at != r or i >= k + j - i:
                lost[r] |= set(range(i, j))
    left = {r: b"".join(p for i, p in enumerate(lines(r[1])) if i not in lost[r]).decode() for r in texts}
    return sorted((str(d), left.get((d, t), t) or "") for d, t in rows)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = dedup_lines(df, passages=True).collect()
    assert sorted((str(r.doc_id), r.deduped or "") for r in got) == brute(rows)
    return got


def test_against_brute_force(spark):
    assert len(check(edge_docs(spark))) == len(EDGE)
    assert sum(r.n_removed for r in check(documents(spark))) > 0
    assert dedup_lines(no_docs(spark), passages=True).count() == 0
    same = "One and the same line of seven.\n" * 9
    check(spark.createDataFrame([(1, same), (2, "Own words. " + same), (None, same), (None, same)], SCHEMA))


def test_frequent_runs_are_salted(spark, monkeypatch):
    from transpark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SALT_ROWS", 4)
    check(spark.createDataFrame([(i, f"Own {i} line. This line is shared by all of them.\nAnd this one here is shared too, word by word.\nOwn {i}.") for i in range(50)], SCHEMA))


def test_runs_of_one_hash_and_other_bytes_stay(spark):
    from pyspark.sql import functions as F

    from transpark.llm.common import Scratch
    from transpark.llm.line_dedup import _without_runs

    docs = spark.createDataFrame([(1, "One two. Three four."), (2, "One two. Three four."), (3, "Five six. Seven.")], SCHEMA)
    keyed = docs.withColumn("_id", F.col("doc_id")).withColumn("_th", F.lit(0).cast("long"))
    run = F.struct(F.lit(0).alias("pos"), F.lit(2).alias("n_lines"), F.lit(7).cast("long").alias("h"), F.lit(3).cast("long").alias("n"), (F.col("_id") == 1).cast("int").alias("is_first"))
    wanted = keyed.select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), F.array(run).alias("wanted"))
    got = {r.doc_id: r.deduped for r in _without_runs(keyed, wanted, Scratch(spark, "test"), docs.schema).collect()}
    assert got == {1: "One two. Three four.", 2: "", 3: "Five six. Seven."}


def test_cover_holds_the_same_lines():
    import numpy as np

    from transpark.llm.line_dedup import cover

    rng = random.Random(4)
    for _ in range(300):
        found = [(p, p + rng.randint(1, 6)) for p in (rng.randrange(40) for _ in range(rng.randrange(25)))]
        held = lambda rs: {i for a, b in rs for i in range(a, b)}
        few = [found[i] for i in cover(*np.array(found, np.int64).reshape(-1, 2).T).tolist()]
        assert held(few) == held(found) and all(held(few[:i] + few[i + 1 :]) != held(found) for i in range(len(few)))


def test_runs_of_several_texts_are_those_of_each():
    import numpy as np

    from transpark.llm.line_dedup import run_hashes, runs

    rng = random.Random(6)
    texts = [[rng.choice([1, 2, 5, 11, 13, 45]) for _ in range(rng.randrange(9))] for _ in range(60)]
    words = np.array([w for t in texts for w in t], np.int64)
    sizes = [len(t) for t in texts]
    first, last = runs(words, np.repeat(np.cumsum(sizes), sizes))
    got, base = [], 0
    want = []
    for t in texts:
        enough = lambda i, j: j - i >= 2 and sum(t[i:j]) >= LEAST_WORDS  # noqa: E731, B023
        spans = {(i, i + 1) for i, w in enumerate(t) if w >= LONG_LINE}
        spans |= {(i, next(j for j in range(i + 2, len(t) + 1) if enough(i, j))) for i in range(len(t)) if any(enough(i, j) for j in range(i + 2, len(t) + 1))}
        spans |= {(next(i for i in range(j - 2, -1, -1) if enough(i, j)), j) for j in range(2, len(t) + 1) if any(enough(i, j) for i in range(j - 1))}
        want += sorted((base + i, base + j) for i, j in spans)
        base += len(t)
    got = sorted(zip(first.tolist(), last.tolist()))
    assert got == sorted(want)
    hashes = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    twice = np.concatenate((hashes[:5], hashes, hashes[:5]))
    n = len(hashes)
    at = run_hashes(twice, np.array([0, 5, n + 5, 1]), np.array([4, 9, n + 9, 5]))
    assert at[0] == at[1] == at[2] != at[3]
    assert runs(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []


def test_runs_are_stored_once_and_filtered_without_their_texts():
    import numpy as np
    import pyarrow as pa

    from transpark.llm import line_dedup as L

    rng = random.Random(11)
    texts = ["one", " ".join(words(rng, n) + "." for n in (14, 9, 17, 3, 41)), "?!", "\n".join(words(rng, n) for n in (5, 10, 3, 12))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9, 10], "th": [1, 2, 3, 4], "text": texts}).slice(1)
    stored = pa.RecordBatch.from_pydict(L._run_hashes(batch))
    assert stored.num_rows == 3 and "text" not in stored.schema.names
    want = set()
    for doc_id, text in zip((8, 9, 10), texts[1:]):
        n = np.array([p.strip().count(b" ") + 1 for p in lines(text)])
        first, last = L.runs(n, np.full(len(n), len(n)))
        want |= {(doc_id, a, b - a) for a, b in zip(first.tolist(), last.tolist())}
    held = L._held(stored, np.full(1 << L.FILTER_BITS - 3, 255, np.uint8))
    got = [(d.as_py(), a, n) for d, a, n in zip(held["doc_id"], held["pos"].tolist(), held["n_lines"].tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    some = np.zeros(1 << L.FILTER_BITS - 3, np.uint8)
    at = int(held["h"][2]) & (1 << L.FILTER_BITS) - 1
    some[at >> 3] |= 1 << (at & 7)
    assert L._held(stored, some)["h"].tolist() == [held["h"][2]]
