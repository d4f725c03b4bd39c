"""Line dedup by content-defined chunks of lines.

The lines of a text are its sentences (a physical line is cut after ``.``, ``!`` and ``?``; what is longer
than ``WRAP`` words is cut after words that their own hash selects). A rolling hash over the hashes of two
neighbouring lines ends a chunk where it is 0 modulo ``AVERAGE``, so that chunk boundaries depend on
content alone and come back after insertions; a physical line of ``LONG_LINE`` words or more begins and
ends a chunk. A chunk of several lines and at least ``LEAST_WORDS`` words that occurs again anywhere in
the table is a repetition: its first occurrence (by doc_id, then place) stays, and every other one is
removed after its bytes have been compared with the first one's.

The narrow chunk hashes are counted with map-side combine; only then do the bytes of chunks move, and
frequent chunks are salted, with a copy of the first occurrence for every salt.

A passage seldom begins and ends at chunk boundaries. With ``passages`` the unit is therefore every run of
lines that is just long enough: the shortest one of at least two lines and ``LEAST_WORDS`` words from each
line on, the shortest one up to each line, and each line of ``LONG_LINE`` words or more. A line goes if it
lies in a run that occurred before (not overlapping its first occurrence), so that a repeated passage goes
from its first to its last line, wherever it stands.

Null and empty texts have no lines and stay. Rows with the same doc_id and text count as one document.
Rows without doc_id come last in the order of occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transpark.llm.common import Scratch, map_batches, mix64, small_batches, table
from transpark.operators.common import join_small

AVERAGE = 4  # lines between chunk boundaries, on average
MOST_LINES = 32  # a chunk ends after as many
LEAST_WORDS = 12  # of a chunk that may be removed
LONG_LINE = 40  # words of a physical line that stands in chunks of its own
WRAP = 40  # words after which a sentence is cut further
SALT_ROWS = 4096  # occurrences of a chunk compared in one task
FILTER_BITS = 28  # of the bitmap of repeated runs' hashes (32 MB)
FILTER_BLOCK = 20  # bits of it that one task fills

_LINE = re.compile(rb"[^.!?]+[.!?]*\s*|[.!?]+\s*")
_PHYSICAL = re.compile(rb"[^\n]*\n|[^\n]+")
_WORD = re.compile(rb"\S+\s*|\s+")


def _wrapped(line: bytes) -> list[bytes]:
    """A very long line, cut after words that their hash selects."""
    out: list[bytes] = []
    run: list[bytes] = []
    for word in _WORD.findall(line):
        run.append(word)
        if xxhash.xxh3_64_intdigest(word.strip()) % (WRAP // 2) == 0:
            out.append(b"".join(run))
            run = []
    return [*out, b"".join(run)] if run else out


def chunks(text: str) -> list[list[bytes]]:
    """The chunks of a text, each a list of lines; all lines together are the text. White space belongs to
    the line before it."""
    out: list[list[bytes]] = []
    now: list[bytes] = []
    before = 0  # hash of the line before
    after_long = False
    open_ = False  # whether a single line left over at a hard boundary may join the chunk before it
    for physical in _PHYSICAL.findall(text.encode("utf-8", "surrogatepass")):
        if physical.isspace() and (now or out):
            (now or out[-1])[-1] += physical
            continue
        long = physical.count(b" ") + 1 >= LONG_LINE
        if (long or after_long) and now:
            if open_ and len(now) == 1:
                out[-1].extend(now)
            else:
                out.append(now)
            now = []
        if long or after_long:
            open_ = False
        after_long = long
        for line in _LINE.findall(physical):
            for part in (line,) if len(line) <= 2 * WRAP or line.count(b" ") <= WRAP else _wrapped(line):
                now.append(part)
                h = xxhash.xxh3_64_intdigest(part.strip())
                if len(now) >= 2 and ((before * 3 + h) % AVERAGE == 0 or len(now) >= MOST_LINES):
                    out.append(now)
                    now, open_ = [], True
                before = h
    if now:
        if open_ and len(now) == 1:
            out[-1].extend(now)
        else:
            out.append(now)
    return out


def canonical(chunk: list[bytes]) -> bytes:
    """The bytes that repetitions have in common: the lines without the white space around them."""
    return b"\n".join([line.strip() for line in chunk])


def removable(chunk: list[bytes], body: bytes) -> bool:
    return len(chunk) >= 2 and body.count(b" ") + len(chunk) >= LEAST_WORDS


def lines(text: str) -> list[bytes]:
    """The lines of a text, which together are the text. White space belongs to the line before it."""
    out: list[bytes] = []
    for physical in _PHYSICAL.findall(text.encode("utf-8", "surrogatepass")):
        if physical.isspace() and out:
            out[-1] += physical
            continue
        found = _LINE.findall(physical)
        if len(physical) <= 2 * WRAP or physical.count(b" ") <= WRAP:
            out += found
            continue
        for line in found:
            if len(line) <= 2 * WRAP or line.count(b" ") <= WRAP:
                out.append(line)
            else:
                out += _wrapped(line)
    return out


def runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the runs that count as passages, of the lines of several texts
    one after the other: from their numbers of words, and the end of the text that each line belongs to."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    line = np.arange(n)
    bounds = np.unique(ends)
    text_start = np.concatenate(([0], bounds))[np.searchsorted(bounds, line, "right")]
    after = np.maximum(np.searchsorted(total, total[:-1] + LEAST_WORDS), line + 2)
    forward = after <= ends
    stop = line + 1
    before = np.minimum(np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1, stop - 2)
    backward = before >= text_start
    long = words >= LONG_LINE
    first = np.concatenate((line[forward], before[backward], line[long]))
    last = np.concatenate((after[forward], stop[backward], stop[long]))
    both = np.unique(first * (n + 1) + last)
    return both // (n + 1), both % (n + 1)


_BASE = 0x9E3779B97F4A7C15  # of the rolling hash, odd
_INVERSE = pow(_BASE, -1, 2**64)


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A rolling hash over line hashes: of every run, the sum of its lines' hashes times powers of ``_BASE``."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
        inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])))
        return mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


def _run_hashes(batch: pa.RecordBatch) -> dict:
    """The runs of every text, a row a text: first lines, numbers of lines and hashes, each as the bytes of
    an array, which Spark stores without looking at every number."""
    parts = [[p.strip() for p in lines(t)] for t in batch.column("text").to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = [p for x in parts for p in x]
    words = np.fromiter((p.count(b" ") + 1 for p in flat), np.int64, len(flat))
    stops = np.cumsum(sizes)
    first, last = runs(words, np.repeat(stops, sizes))
    hashes = run_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), first, last).view(np.int64)
    bounds = np.concatenate(([0], np.searchsorted(first, stops)))
    pos = (first - np.repeat(stops - sizes, np.diff(bounds))).astype(np.int32)
    return {k: batch.column(k) for k in ("doc_id", "th")} | {
        k: pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((bounds * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
        for k, v in (("pos", pos), ("n_lines", (last - first).astype(np.int32)), ("h", hashes))
    }


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _held(batch: pa.RecordBatch, bits: np.ndarray) -> dict:
    """Of the runs of a batch of texts, a row each, those whose hashes ``bits`` holds."""
    h = _numbers(batch.column("h"), np.int64)
    at = h & (1 << FILTER_BITS) - 1
    there = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    n_runs = pc.binary_length(batch.column("h")).to_numpy() // h.itemsize
    text = pa.array(np.repeat(np.arange(batch.num_rows), n_runs)[there])
    keys = {k: batch.column(k).take(text) for k in ("doc_id", "th")}
    return keys | {k: _numbers(batch.column(k), np.int32)[there] for k in ("pos", "n_lines")} | {"h": h[there]}


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of all ``h``: a fixed size, whatever their number."""
    at = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << FILTER_BLOCK, np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = hashes.select(F.shiftright(at, FILTER_BLOCK).cast("int").alias("block"), at.bitwiseAND((1 << FILTER_BLOCK) - 1).cast("int").alias("bit")).distinct()
    out = bytearray(1 << FILTER_BITS - 3)
    size = 1 << FILTER_BLOCK - 3
    for r in blocks.groupBy("block").applyInPandas(run, "block int, bits binary").collect():
        out[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    return np.frombuffer(bytes(out), np.uint8)


def _run_bodies(batch: pa.RecordBatch) -> dict:
    wanted = batch.column("_wanted")
    row, flat = pc.list_parent_indices(wanted), pc.list_flatten(wanted)
    each = zip(row.to_pylist(), flat.field("pos").to_pylist(), flat.field("n_lines").to_pylist())
    texts_ = batch.column("text").to_pylist()
    bodies, now, parts = [], -1, []
    for i, pos, n_lines in each:
        if i != now:
            now, parts = i, [p.strip() for p in lines(texts_[i])]
        bodies.append(b"\n".join(parts[pos : pos + n_lines]))
    out = {"doc_id": batch.column("_id").take(row), "th": batch.column("_th").take(row)}
    return out | {k: flat.field(k) for k in ("pos", "n_lines", "h", "n", "is_first")} | {"body": pa.array(bodies, pa.binary())}


def _occurrences(batch: pa.RecordBatch, with_bytes: bool) -> dict:
    out: dict[str, list] = {"doc_id": [], "th": [], "pos": [], "h": [], **({"body": []} if with_bytes else {})}
    for doc_id, th, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "th", "text"))):
        for i, chunk in enumerate(chunks(text)):
            body = canonical(chunk)
            if removable(chunk, body):
                for k, v in zip(out, (doc_id, th, i, xxhash.xxh3_64_intdigest(body) - 2**63, body)):
                    out[k].append(v)
    return {k: pa.array(v, {"pos": pa.int32(), "body": pa.binary()}.get(k, pa.int64())) for k, v in out.items()}


def _repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, th, pos`` of every chunk to remove (null ids as the largest long)."""
    narrow = map_batches(docs, lambda b: _occurrences(b, False), "doc_id long, th long, pos int, h long")
    place = F.struct("doc_id", "th", "pos")
    first = narrow.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    first = scratch.write(first.where("first <> last").select("h", "n", "first"), "first")
    bodies = map_batches(docs, lambda b: _occurrences(b, True), "doc_id long, th long, pos int, h long, body binary")
    found = bodies.join(first, "h").withColumn("is_first", (place == F.col("first")).cast("int"))
    return _compared(found, "pos").select("doc_id", "th", "pos")


def cover(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of a few runs that hold the same lines as all of them: from the first line not held on,
    always the run that reaches furthest."""
    order = np.lexsort((-ends, starts))
    reach = np.maximum.accumulate(ends[order])
    order = order[np.concatenate((np.ones(min(1, len(order)), bool), reach[1:] > reach[:-1]))]  # the others lie inside one before
    s, e = starts[order].tolist(), ends[order].tolist()
    out, held, i, n = [], -1, 0, len(s)
    while i < n:
        line = max(held, s[i])  # the first line not held
        while i + 1 < n and s[i + 1] <= line:
            i += 1
        out.append(i)
        held = e[i]
        i += 1
    return order[out]


def _covers(batch: pa.RecordBatch) -> dict:
    found = batch.column("found")
    row, flat = pc.list_parent_indices(found).to_numpy().astype(np.int64), pc.list_flatten(found)
    pos, n_lines = (flat.field(k).to_numpy().astype(np.int64) for k in ("pos", "n_lines"))
    apart = row * (int((pos + n_lines).max(initial=0)) + 1)  # the runs of a batch's texts on one line
    few = pa.array(cover(apart + pos, apart + pos + n_lines))
    keys = {k: batch.column(k).take(pa.array(row)).take(few) for k in ("doc_id", "th")}
    return keys | {k: flat.field(k).take(few) for k in ("pos", "n_lines", "h", "n")}


def _repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, th, wanted`` (runs as ``pos, n_lines, h, n, is_first``) of the documents whose bytes are needed:
    texts are cut once and their runs stored, bare hashes are counted first, places move for runs alone that pass the bitmap of repeated hashes, and of
    a document's repetitions as many runs are compared as hold all its repeated lines."""
    every = scratch.write(map_batches(docs, _run_hashes, "doc_id long, th long, pos binary, n_lines binary, h binary"), "every")
    hashes = map_batches(every.select("h"), lambda b: {"h": _numbers(b.column("h"), np.int64)}, "h long")
    repeated = scratch.write(hashes.groupBy("h").count().where("count > 1").select("h"), "repeated")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(repeated))
    schema = "doc_id long, th long, pos int, n_lines int, h long"
    narrow = scratch.write(map_batches(every, lambda b: _held(b, bits.value), schema), "runs")
    scratch.drop(every, repeated)
    place = F.struct("doc_id", "th", "pos")
    first = narrow.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "n_lines")).alias("first"), F.max(place).alias("last"))
    first = scratch.write(first.where(F.struct("first.doc_id", "first.th", "first.pos") != F.col("last")).select("h", "n", "first"), "first")
    found = narrow.join(first, "h")
    at_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = found.where(~(at_first & (F.col("pos") < F.col("first.pos") + F.col("n_lines"))))
    of_doc = later.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n_lines", "h", "n")).alias("found"))
    chosen = scratch.write(map_batches(of_doc, _covers, "doc_id long, th long, pos int, n_lines int, h long, n long"), "chosen")
    needed = chosen.select("h").distinct().join(first, "h").select("first.*", "h", "n").withColumn("is_first", F.lit(1))
    both = chosen.withColumn("is_first", F.lit(0)).unionByName(needed)
    return both.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n_lines", "h", "n", "is_first")).alias("wanted"))


def _compared(found: DataFrame, *columns: str, equal: bool = True) -> DataFrame:
    """``doc_id, th`` and ``columns`` (ints) of the later occurrences ``h, n, is_first, body`` whose bytes are
    those of the first one, or are not."""
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    # the first occurrence goes to every salt of its chunk, each other one to a salt by its document
    own = F.when(F.col("is_first") == 1, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "th", "pos"), salts).cast("int")))
    dealt = found.select("h", F.explode(own).alias("salt"), "doc_id", "th", *columns, "body", "is_first")
    dealt = dealt.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "salt")
    dealt = dealt.sortWithinPartitions("h", "salt", F.desc("is_first"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, body = None, b""
        for batch in it:
            rows = zip(*(batch.column(k).to_pylist() for k in ("h", "salt", "is_first", "body")))
            same = []
            for h, salt, is_first, other in rows:
                if is_first:
                    key, body = (h, salt), other
                same.append(not is_first and (key == (h, salt) and body == other) == equal)
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", "th", *columns)}).filter(pa.array(same, pa.bool_()))

    return dealt.mapInArrow(compare, ", ".join(["doc_id long, th long", *(f"{c} int" for c in columns)]))


def _with_result(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n_removed long, deduped string"


def _without_runs(keyed: DataFrame, wanted: DataFrame, scratch: Scratch, schema: StructType) -> DataFrame:
    """Documents without the lines of their repeated runs. Texts with wanted runs move once, to their runs,
    the others not at all: a bitmap of the keys tells them apart where they are. Runs of one hash
    and different bytes, hardly ever any, are what is joined afterwards."""
    wanted = scratch.write(wanted.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("wanted").alias("_wanted")), "wanted")
    key = F.xxhash64("_id", "_th")
    bits = keyed.sparkSession.sparkContext.broadcast(_filter(wanted.select(key.alias("h"))))

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (1 << FILTER_BITS) - 1
        return pd.Series((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    keyed = keyed.withColumn("_asked", asked(key))
    names = [f.name for f in schema]
    stay = keyed.where(~F.col("_asked")).select(*names, F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("deduped"))
    joined = scratch.write(keyed.where("_asked").drop("_asked").join(wanted, ["_id", "_th"], "left"), "joined")
    bodies = map_batches(joined.where("_wanted is not null").select("_id", "_th", "text", "_wanted"), _run_bodies, "doc_id long, th long, pos int, n_lines int, h long, n long, is_first int, body binary")
    other = scratch.write(_compared(bodies, "pos", "n_lines", equal=False), "other")
    other = other.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("pos", "n_lines")).alias("_other"))
    joined = join_small(joined, other, ["_id", "_th"], "left").select(*names, "_wanted", "_other")

    def rebuild(batch: pa.RecordBatch) -> dict:
        n_removed, deduped = [], []
        wanted_ = batch.column("_wanted")
        later = pa.RecordBatch.from_arrays([pc.list_parent_indices(wanted_), *pc.list_flatten(wanted_).flatten()], ["row", *(f.name for f in wanted_.type.value_type)])
        later = later.filter(pc.equal(later.column("is_first"), 0))
        gone: dict[int, list[tuple[int, int]]] = {}
        for i, pos, n_lines in zip(*(later.column(k).to_pylist() for k in ("row", "pos", "n_lines"))):
            gone.setdefault(i, []).append((pos, n_lines))
        for i, (text, other_) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("text", "_other")))):
            stay = {(o["pos"], o["n_lines"]) for o in other_ or ()}
            lost: set[int] = set()
            for pos, n_lines in gone.get(i, ()):
                if (pos, n_lines) not in stay:
                    lost.update(range(pos, pos + n_lines))
            n_removed.append(len(lost))
            deduped.append(text if not lost else b"".join([p for i, p in enumerate(lines(text)) if i not in lost]).decode("utf-8", "surrogatepass"))
        keep = {c: batch.column(c) for c in batch.schema.names if c not in ("_wanted", "_other")}
        return keep | {"n_removed": n_removed, "deduped": pa.array(deduped, pa.string())}

    return map_batches(joined, rebuild, _with_result(schema)).unionByName(stay)


def dedup_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """Add ``n_removed`` (lines) and ``deduped`` (the text without repeated chunks, or with ``passages``
    without repeated runs of lines; null stays null) to documents (``doc_id, text, ...``); columns of these
    names are replaced. An empty table gives an empty one."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_removed", "deduped", "_id", "_th", "_gone", "_wanted", "_other")
    scratch = Scratch(spark, "lines")
    no_id = 2**63 - 1
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id))).withColumn("_th", F.xxhash64("text"))
    texts = keyed.where("text <> ''").select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), "text")
    if passages:
        return _without_runs(keyed, _repeated_runs(texts, scratch), scratch, docs.schema)
    gone = _repeats(texts, scratch).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone"))
    joined = keyed.join(gone, ["_id", "_th"], "left").drop("_id", "_th")
    def rebuild(batch: pa.RecordBatch) -> dict:
        n_removed, deduped = [], []
        for text, gone_ in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist()):
            lost = set(gone_ or ())
            parts = chunks(text) if lost else []
            n_removed.append(sum(len(parts[i]) for i in lost))
            deduped.append(text if not lost else b"".join(b"".join(c) for i, c in enumerate(parts) if i not in lost).decode("utf-8", "surrogatepass"))
        keep = {c: batch.column(c) for c in batch.schema.names if c != "_gone"}
        return keep | {"n_removed": n_removed, "deduped": pa.array(deduped, pa.string())}

    return map_batches(joined, rebuild, _with_result(docs.schema))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, passages=True).select("doc_id", F.col("deduped").alias("text"), "n_removed")
