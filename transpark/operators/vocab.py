"""Vocabulary and id layers.

Special symbols and their ids follow the usual translation-toolkit
dictionary: ``<s>`` 0, ``<pad>`` 1, ``</s>`` 2, ``<unk>`` 3, then the tokens
by count descending, ties by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transpark.operators import common
from transpark.operators.numbering import dense_index
from transpark.session import TEXT_CODEC, materialize

# Special symbols in id order, and the label mask value.
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")
BOS, PAD, EOS, UNK = 0, 1, 2, 3
IGNORE = -100

# Of a vocabulary too large to broadcast, the first entries (ids follow frequency) are still
# broadcast, as far as their tokens have at most HOT_TOKEN_BYTES, so their size is bounded (64 MB of tokens).
HOT_ENTRIES = 262_144
HOT_TOKEN_BYTES = 256


def build_vocab(df: DataFrame, tokens: str, threshold: int = 0, n: int | None = None, specials=SPECIALS) -> DataFrame:
    """A1: ``token, cnt, id`` from an array-of-tokens column. Tokens are counted by Arrow batches (Spark bounds
    these in rows and bytes) before they move; ids come from a dense numbering, not a global window."""
    col = df.select(tokens)
    schema = T.StructType([T.StructField("token", col.schema[0].dataType.elementType), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.list_flatten(batch.column(0)).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=schema.names)

    counts = col.mapInArrow(run, schema).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    counts = counts.filter(F.col("cnt") >= threshold)
    numbered = dense_index(counts, [F.desc("cnt"), F.asc("token")], name="_r")
    if n is not None:
        numbered = numbered.filter(F.col("_r") < n)
    body = numbered.select("token", "cnt", (F.col("_r") + F.lit(len(specials))).cast("int").alias("id"))
    spark = df.sparkSession
    spec = spark.createDataFrame([(s, 1, i) for i, s in enumerate(specials)], "token STRING, cnt LONG, id INT")
    return spec.unionByName(body)


_LOW = 1 << 32  # of a place and an id as one long: the id is below


def _known_elements(rows: DataFrame, hot: DataFrame, default) -> tuple[DataFrame, list]:
    """Elements of the last column ``_arr`` looked up in ``hot`` (an element and its value; bounded) batch by batch: in
    its place ``_known``, the values (null where there is none; ``default`` for null elements), and ``_asked``,
    place and element where ``hot`` has none. Also the elements that ``hot`` has more than once: they count as
    not there."""
    table = hot.toArrow().combine_chunks()
    found = table.column(0).combine_chunks().value_counts()
    repeated = found.field("values").filter(pc.greater(found.field("counts"), 1))
    table = table.filter(pc.invert(pc.is_in(table.column(0), value_set=repeated)))
    sent = rows.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in table.columns])
    element, value = (f.dataType for f in hot.schema.fields)
    asked_type = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("el", element)])
    fields = [*rows.schema.fields[:-1], T.StructField("_known", T.ArrayType(value)), T.StructField("_asked", T.ArrayType(asked_type))]
    schema = T.StructType(fields)

    def lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, values = sent.value
        for batch in batches:
            arr = batch.column(batch.num_columns - 1)
            lengths = pc.fill_null(pc.list_value_length(arr), 0).to_numpy().astype(np.int64)
            flat = pc.list_flatten(arr)
            coded = flat.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=elements.cast(coded.dictionary.type)).take(coded.indices)
            known = values.take(place)
            if default is not None:
                known = pc.if_else(flat.is_null(), pa.scalar(default, known.type), known)
            asked = pc.and_(place.is_null(), flat.is_valid())
            at = np.flatnonzero(asked.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(lengths)), lengths)[at]
            pos = at - (np.cumsum(lengths) - lengths)[row]
            pairs = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), flat.take(pa.array(at))], ["pos", "el"])
            new = [lists(lengths, known), lists(np.bincount(row, minlength=len(lengths)), pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return rows.mapInArrow(run, schema), repeated.to_pylist()


def _lookup_by_row(df: DataFrame, arr: Column, vocab: DataFrame, on: str, value: str, default, key: list[str], out: str, keep: list[str] | None = None):
    """Per-element lookup of ``arr`` in ``vocab`` (``token, id``) keeping element order.

    Elements are exploded, looked up in the broadcast vocabulary and collected per row before one
    exchange on ``key``; the other columns of a row travel with its first element only. A row's elements
    are one row's worth of data, so no group outgrows its row. A vocabulary above the broadcast limit is
    split by id: elements are looked up in the frequent entries batch by batch, within their rows, and only
    those not found there are exploded and shuffle-joined with the rest, so frequent tokens never meet in one
    partition. Without a ``default`` elements that have no value may be left out.
    """
    rest = [c for c in (df.columns if keep is None else keep) if c not in key and c != out]
    rows = df.select(*key, F.struct(F.lit(0).alias("_tp"), *rest).alias("_row"), arr.alias("_arr"))
    side = materialize(vocab.select("token", "id"), "vocab")
    look = lambda v: v.select(on, F.col(value).alias("_val"))
    if value == "id" and default is not None:
        # place and id as one long: eight bytes an element, sorted as numbers
        item = lambda pos, val: pos.cast("long") * _LOW + (val.cast("long") + (_LOW >> 1))
        of_item = lambda x: (F.pmod(x, F.lit(_LOW)) - (_LOW >> 1)).cast("int")
    else:
        item = lambda pos, val: F.struct(pos.alias("_pos"), val.alias("_v"))
        of_item = lambda x: x["_v"]
    val = F.coalesce(F.col("_val"), F.lit(default)) if default is not None else F.col("_val")
    first = F.first("_row", ignorenulls=True).alias("_row")
    if common.table_bytes(side) <= common.BROADCAST_BYTES:
        ex = rows.select(*key, "_row", F.posexplode_outer("_arr").alias("_pos", on))
        ex = ex.withColumn("_row", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_row")))
        hit = ex.join(F.broadcast(look(side)), on, "left")
        items = F.collect_list(F.when(F.col("_pos").isNotNull(), item(F.col("_pos"), val)))
    else:
        kind = "string" if on == "token" else "long"
        rows = rows.withColumn("_arr", F.col("_arr").cast(f"array<{kind}>"))
        side = side.withColumn(on, F.col(on).cast(kind))
        hot = (F.col("id") < len(SPECIALS) + HOT_ENTRIES) & (F.octet_length("token") <= HOT_TOKEN_BYTES)
        known, repeated = _known_elements(rows, look(side.filter(hot)), default)
        known = materialize(known, "known", TEXT_CODEC)
        cold = side.filter(~hot | F.col(on).isin(repeated) if repeated else ~hot)
        asked = known.select(*key, F.inline("_asked").alias("_pos", on)).join(look(cold), on, "inner" if default is None else "left")
        rare = asked.select(*key, item(F.col("_pos"), val).alias("_item"))
        hit = known.select(*key, "_row", "_known").unionByName(rare, allowMissingColumns=True)
        of_row = lambda a: F.filter(F.transform(a, lambda v, i: F.when(v.isNotNull(), item(i, v))), lambda x: x.isNotNull())
        items = F.concat(F.flatten(F.transform(F.collect_list("_known"), of_row)), F.collect_list("_item"))
    packed = hit.groupBy(*key).agg(first, F.sort_array(items).alias("_p"))
    return packed.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest], F.transform("_p", of_item).alias(out))


def encode_ids(
    df: DataFrame, tokens: str, vocab: DataFrame, key: list[str], out: str = "ids", unk: int = UNK, keep: list[str] | None = None
) -> DataFrame:
    """Tokens -> ids with ``<unk>`` for unknown tokens. ``key`` is a unique row key; of the other columns
    those of ``keep`` stay (None: all), and only they travel."""
    v = vocab.filter(~F.col("token").isin(*SPECIALS))
    return _lookup_by_row(df, F.col(tokens), v, "token", "id", unk, key, out, keep)


def decode_ids(
    df: DataFrame, ids: str, vocab: DataFrame | None = None, key: list[str] | None = None, out: str = "text", skip_special: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Ids -> text. Without a vocabulary the ids themselves are joined by blanks; with one,
    ``key`` is a unique row key, and of the other columns those of ``keep`` stay (None: all)."""
    arr = F.col(ids)
    if skip_special:
        arr = F.filter(arr, lambda i: i >= F.lit(len(SPECIALS)))
    if vocab is None:
        return df.withColumn(out, F.array_join(F.transform(arr, lambda i: i.cast("string")), " "))
    if not key:
        raise ValueError("a unique row key is needed to decode with a vocabulary")
    res = _lookup_by_row(df, arr, vocab, "id", "token", None, key, "_toks", keep)
    return res.withColumn(out, F.array_join("_toks", " ")).drop("_toks")


def decode_labels(packed: DataFrame, vocab: DataFrame, key: list[str], col: str = "labels", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """P6 + J3: the text that truncated, padded and masked label ids stand for."""
    return decode_ids(unmask_labels(packed, col), col, vocab, key, out, keep=keep)


def _fit(arr: Column, max_len: int, pad: int, eos: int | None) -> Column:
    body = F.slice(arr, 1, max_len - (1 if eos is not None else 0))
    if eos is not None:
        body = F.concat(body, F.array(F.lit(eos)))
    return body


def _pad_to(arr: Column, length: Column | int, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    n = F.greatest(length - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(F.lit(value), n))


def pack_examples(
    df: DataFrame, src_ids: str, tgt_ids: str, max_len: int = 64, pad: int = PAD, eos: int | None = EOS, ignore: int = IGNORE
) -> DataFrame:
    """Truncate (keeping the end-of-sentence id), pad to ``max_len``, attention mask,
    labels with padding masked as ``ignore``."""
    src = _fit(F.col(src_ids), max_len, pad, eos)
    tgt = _fit(F.col(tgt_ids), max_len, pad, eos)
    return (
        df.withColumn("input_ids", _pad_to(src, max_len, pad))
        .withColumn("attention_mask", _pad_to(F.array_repeat(F.lit(1), F.size(src)), max_len, 0))
        .withColumn("labels", _pad_to(tgt, max_len, ignore))
    )


def pad_to_batch_max(df: DataFrame, ids: str, batch_col: str, pad: int = PAD, out: str | None = None) -> DataFrame:
    """P5: pad each row to the longest row of its batch (a batch is small: batch-size rows)."""
    w = Window.partitionBy(batch_col)
    longest = F.max(F.size(ids)).over(w)
    return df.withColumn("batch_len", longest.cast("long")).withColumn(
        out or ids, _pad_to(F.col(ids), F.col("batch_len").cast("int"), pad)
    )


def unmask_labels(df: DataFrame, col: str = "labels", pad: int = PAD, ignore: int = IGNORE) -> DataFrame:
    """``ignore`` -> pad id before decoding."""
    return df.withColumn(col, F.transform(col, lambda x: F.when(x == F.lit(ignore), F.lit(pad)).otherwise(x)))
