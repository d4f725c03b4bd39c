"""Registered queries over the driver tables, each with its DuckDB twin.

Every query reads whole tables (or data Spark derives from them); nothing is
sampled, capped or cut to a prefix. Doubles that come out of a transcendental
function are rounded half-up to 6 places on both sides with the same IEEE
operations (``floor(x * 1e6 + 0.5) / 1e6``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.functions import text as T
from transpark.operators import bleu as B
from transpark.operators import select as S
from transpark.operators import text_jobs as TJ
from transpark.operators.numbering import dense_index, number_by_key
from transpark.plans import oracle_sql as Q
from transpark.session import delete, materialize, temporary
from transpark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


# --- P1-P3: words, counts, type-token ratio ---------------------------------


@register(
    "word_stats",
    f"""SELECT doc_id, lang, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_unique, {Q.ttr_of('w')} AS ttr
        FROM (SELECT doc_id, lang, {Q.words('text')} AS w FROM documents)""",
)
def word_stats(spark, d):
    docs = table(spark, d, "documents")
    w = T.words("text")
    return docs.select(
        "doc_id",
        "lang",
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_unique"),
        T.ttr("text").alias("ttr"),
    )


@register(
    "word_counts",
    f"""SELECT doc_id, word, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({Q.words('text')}) AS word FROM documents) GROUP BY doc_id, word""",
)
def word_counts(spark, d):
    """P2 exploded: the number of every word of a document."""
    return TJ.word_counts(table(spark, d, "documents"), "text", ["doc_id"])


@register(
    "word_counter",
    f"""SELECT doc_id, coalesce(string_agg(word || '=' || n, ' ' ORDER BY word), '') AS counter FROM (
          SELECT doc_id, word, count(*) FILTER (word IS NOT NULL) AS n FROM (
            SELECT doc_id, unnest(CASE WHEN len({Q.words('text')}) = 0 THEN [NULL] ELSE {Q.words('text')} END) AS word FROM documents) GROUP BY doc_id, word) GROUP BY doc_id""",
)
def word_counter(spark, d):
    """The counter of every document, as text."""
    docs = TJ.add_word_counter(table(spark, d, "documents"), "text", "c")
    return docs.select("doc_id", F.array_join(F.transform(F.map_entries("c"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("counter"))


# --- T1/T2: diversity selection ---------------------------------------------


def _doc_corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("src"), "lang")


_TTR_DOCS = f"SELECT doc_id, lang, {Q.ttr_of('w')} AS ttr FROM (SELECT doc_id, lang, {Q.words('text')} AS w FROM documents)"


@register(
    "diversity_select",
    f"""SELECT doc_id, lang, ttr FROM (
          SELECT *, row_number() OVER (ORDER BY ttr DESC NULLS LAST, doc_id) AS rn, count(*) OVER () AS n FROM ({_TTR_DOCS}))
        WHERE rn <= trunc(n * 0.5::DOUBLE)""",
)
def diversity_select(spark, d):
    sel = S.diversity_select(_doc_corpus(spark, d), 0.5)
    return sel.select(F.col("idx").alias("doc_id"), "lang", "ttr")


@register(
    "diversity_select_by_lang",
    f"""SELECT doc_id, lang, ttr FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ttr DESC NULLS LAST, doc_id) AS rn,
                 count(*) OVER (PARTITION BY lang) AS n FROM ({_TTR_DOCS}))
        WHERE rn <= trunc(n * 0.3::DOUBLE)""",
)
def diversity_select_by_lang(spark, d):
    sel = S.diversity_select(_doc_corpus(spark, d), 0.3, by=["lang"])
    return sel.select(F.col("idx").alias("doc_id"), "lang", "ttr")


@register(
    "diversity_sweep",
    f"""SELECT doc_id, ttr, rn <= trunc(n * 0.3::DOUBLE) AS sel_30, rn <= trunc(n * 0.5::DOUBLE) AS sel_50,
               rn <= trunc(n * 0.7::DOUBLE) AS sel_70, rn <= trunc(n * 1.0::DOUBLE) AS sel_100 FROM (
          SELECT *, row_number() OVER (ORDER BY ttr DESC NULLS LAST, doc_id) AS rn, count(*) OVER () AS n FROM ({_TTR_DOCS}))""",
)
def diversity_sweep(spark, d):
    out = S.diversity_sweep(_doc_corpus(spark, d), [0.3, 0.5, 0.7, 1.0])
    return out.select(F.col("idx").alias("doc_id"), "ttr", "sel_30", "sel_50", "sel_70", "sel_100")


def doc_lines(spark, d) -> DataFrame:
    """Lines of every document as a line corpus with a dense ``idx`` in (doc_id, line_no) order."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines("text")).alias("line_no", "line"))
    docs = docs.withColumn("line_no", F.col("line_no").cast("long"))
    return dense_index(docs, ["doc_id", "line_no"], name="idx")


_LINES_SQL = """SELECT doc_id, (i - 1)::BIGINT AS line_no, arr[i] AS line FROM (
    SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS arr FROM documents))"""


@register(
    "diversity_select_lines",
    f"""SELECT doc_id, line_no, ttr FROM (
          SELECT *, row_number() OVER (ORDER BY ttr DESC NULLS LAST, doc_id, line_no) AS rn, count(*) OVER () AS n FROM (
            SELECT doc_id, line_no, {Q.ttr_of('w')} AS ttr FROM (SELECT doc_id, line_no, {Q.words('line')} AS w FROM ({_LINES_SQL}))))
        WHERE rn <= trunc(n * 0.5::DOUBLE)""",
)
def diversity_select_lines(spark, d):
    lines = doc_lines(spark, d)
    sel = S.diversity_select(lines, 0.5, score_col="line")
    return sel.select("doc_id", "line_no", "ttr")


_SPLIT_LINES_SQL = f"""SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split
    FROM ({_LINES_SQL})"""


@register(
    "diversity_select_splits",
    f"""WITH n AS (SELECT split, (row_number() OVER (PARTITION BY split ORDER BY doc_id, line_no) - 1)::BIGINT AS idx,
                          {Q.words('line')} AS w FROM ({_SPLIT_LINES_SQL}))
        SELECT split, idx, ttr FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY ttr DESC NULLS LAST, idx) AS rn,
                 count(*) OVER (PARTITION BY split) AS n FROM (SELECT split, idx, {Q.ttr_of('w')} AS ttr FROM n))
        WHERE rn <= trunc(n * 0.35::DOUBLE)""",
)
def diversity_select_splits(spark, d):
    """T1 over a dataset whose splits each number their lines from 0."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines("text")).alias("line_no", "src"))
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    lines = dense_index(docs.withColumn("split", split), ["doc_id", "line_no"], partition_by=["split"], name="idx")
    return S.diversity_select(lines, 0.35, by=["split"]).select("split", "idx", "ttr")


# --- A2-A6, A13: BLEU over document pairs -------------------------------------


def doc_pairs(spark, d) -> DataFrame:
    """hyp = the document with every 7th word left out, ref = the document; ``idx`` dense per language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("ref"))
    docs = dense_index(docs, ["doc_id"], partition_by=["lang"], name="idx")  # one text goes through it
    hyp = F.array_join(F.filter(T.words("ref"), lambda w, i: i % 7 != 6), " ")
    return docs.select("doc_id", "lang", hyp.alias("hyp"), "ref", "idx")


_DOC_PAIRS_SQL = f"""SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS idx, doc_id,
       array_to_string(list_filter({Q.words('text')}, lambda x, i: (i - 1) % 7 <> 6), ' ') AS hyp, text AS ref
    FROM documents"""


def _doc_stats(spark, d) -> DataFrame:
    """Segment statistics keyed by (lang, doc_id), then numbered densely per language.
    Numbering the narrow statistics rows avoids carrying the text through the numbering."""
    docs = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.array_join(F.filter(T.words("text"), lambda w, i: i % 7 != 6), " ").alias("hyp"),
        F.col("text").alias("ref"),
    )
    stats = materialize(B.segment_stats(docs, keys=["lang", "doc_id"]), "docstats")
    return dense_index(stats, ["doc_id"], partition_by=["lang"], name="idx")


def _rounded_bleu(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in ["bleu", "bp", "p1", "p2", "p3", "p4"]], *B.STAT_COLS)


@register(
    "corpus_bleu_by_lang",
    f"""WITH {Q.segment_stats(_DOC_PAIRS_SQL, ['lang', 'idx'])},
        s AS (SELECT lang, {Q.sums()} FROM seg GROUP BY lang)
        SELECT lang, {Q.bleu_cols()}, {', '.join(Q.STATS)} FROM s""",
)
def corpus_bleu_by_lang(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.array_join(F.filter(T.words("text"), lambda w, i: i % 7 != 6), " ").alias("hyp"),
        F.col("text").alias("ref"),
    )
    stats = B.segment_stats(docs, keys=["lang", "doc_id"])
    return _rounded_bleu(B.corpus_bleu(stats, ["lang"]), ["lang"])


@register(
    "batch_bleu_by_lang",
    f"""WITH {Q.segment_stats(_DOC_PAIRS_SQL, ['lang', 'idx'])},
        s AS (SELECT lang, (idx // 32)::BIGINT AS batch_id, {Q.sums()} FROM seg GROUP BY ALL)
        SELECT lang, batch_id, {Q.bleu_cols()}, {', '.join(Q.STATS)} FROM s""",
)
def batch_bleu_by_lang(spark, d):
    return _rounded_bleu(B.batch_bleu(_doc_stats(spark, d), 32, ["lang"]), ["lang", "batch_id"])


_BATCH_SCORES = f"""WITH {Q.segment_stats(_DOC_PAIRS_SQL, ['lang', 'idx'])},
        s AS (SELECT lang, (idx // 32)::BIGINT AS batch_id, {Q.sums()} FROM seg GROUP BY ALL),
        b AS (SELECT lang, batch_id, {Q.bleu_raw()} AS bleu FROM s)"""


@register(
    "bleu_mean_std_by_lang",
    f"""{_BATCH_SCORES}
        SELECT lang, {Q.r6('avg(bleu)')} AS bleu_mean, {Q.r6('stddev_samp(bleu)')} AS bleu_std, count(*)::BIGINT AS n_batches
        FROM b GROUP BY lang""",
)
def bleu_mean_std_by_lang(spark, d):
    out = B.bleu_mean_std(_doc_stats(spark, d), 32, ["lang"])
    return out.select("lang", r6("bleu_mean").alias("bleu_mean"), r6("bleu_std").alias("bleu_std"), "n_batches")


@register(
    "bleu_mean_by_lang",
    f"""{_BATCH_SCORES}
        SELECT lang, {Q.r6('avg(bleu)')} AS bleu_mean FROM b GROUP BY lang""",
)
def bleu_mean_by_lang(spark, d):
    out = B.bleu_mean(_doc_stats(spark, d), 32, ["lang"])
    return out.select("lang", r6("bleu_mean").alias("bleu_mean"))


@register(
    "validation_bleu_by_lang",
    f"""{_BATCH_SCORES},
        nb AS (SELECT lang, count(*) AS nb FROM b GROUP BY lang)
        SELECT lang, {Q.r6('avg(bleu)')} AS val_bleu, count(*)::BIGINT AS n_batches
        FROM b JOIN nb USING (lang) WHERE batch_id < floor(nb * 0.25::DOUBLE) GROUP BY lang""",
)
def validation_bleu_by_lang(spark, d):
    out = B.validation_bleu(_doc_stats(spark, d), 32, 0.25, ["lang"])
    return out.select("lang", r6("val_bleu").alias("val_bleu"), "n_batches")


# --- J1 and BLEU over conversation pairs ----------------------------------------


def conversation_pairs(spark, d) -> DataFrame:
    """A user turn and the assistant turn right after it, as (src, tgt)."""
    conv = table(spark, d, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return u.join(a, ["conv_id", "turn"])


_CONV_PAIRS_SQL = """SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


@register("conversation_pairs", _CONV_PAIRS_SQL)
def q_conversation_pairs(spark, d):
    return conversation_pairs(spark, d).select("conv_id", "turn", "src", "tgt")


def _conv_stats(spark, d, numbered: bool = True) -> DataFrame:
    pairs = conversation_pairs(spark, d).select(
        "conv_id", "turn", F.col("src").alias("hyp"), F.col("tgt").alias("ref"), F.lit("conv").alias("run")
    )
    stats = B.segment_stats(pairs, keys=["run", "conv_id", "turn"])
    if not numbered:
        return stats
    return dense_index(materialize(stats, "convstats"), ["conv_id", "turn"], partition_by=["run"], name="idx")


_CONV_BLEU_PAIRS = f"""SELECT 'conv' AS run, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx, src AS hyp, tgt AS ref
    FROM ({_CONV_PAIRS_SQL})"""


@register(
    "conversation_bleu",
    f"""WITH {Q.segment_stats(_CONV_BLEU_PAIRS, ['run', 'idx'])},
        s AS (SELECT run, {Q.sums()} FROM seg GROUP BY run)
        SELECT run, {Q.bleu_cols()}, {', '.join(Q.STATS)} FROM s""",
)
def conversation_bleu(spark, d):
    return _rounded_bleu(B.corpus_bleu(_conv_stats(spark, d, numbered=False), ["run"]), ["run"])


@register(
    "conversation_bleu_mean_std",
    f"""WITH {Q.segment_stats(_CONV_BLEU_PAIRS, ['run', 'idx'])},
        s AS (SELECT run, (idx // 8)::BIGINT AS batch_id, {Q.sums()} FROM seg GROUP BY ALL),
        b AS (SELECT run, batch_id, {Q.bleu_raw()} AS bleu FROM s)
        SELECT run, {Q.r6('avg(bleu)')} AS bleu_mean, {Q.r6('stddev_samp(bleu)')} AS bleu_std, count(*)::BIGINT AS n_batches
        FROM b GROUP BY run""",
)
def conversation_bleu_mean_std(spark, d):
    out = B.bleu_mean_std(_conv_stats(spark, d), 8, ["run"])
    return out.select("run", r6("bleu_mean").alias("bleu_mean"), r6("bleu_std").alias("bleu_std"), "n_batches")


# --- A1, J2, J3, P4-P6: vocabulary and ids -------------------------------------

from transpark.operators import vocab as V  # noqa: E402

_COUNTS_SQL = f"""SELECT token, count(*)::BIGINT AS cnt FROM (SELECT unnest({Q.words('text')}) AS token FROM documents) GROUP BY token"""
_SPECIALS_SQL = "SELECT * FROM (VALUES ('<s>', 1::BIGINT, 0), ('<pad>', 1::BIGINT, 1), ('</s>', 1::BIGINT, 2), ('<unk>', 1::BIGINT, 3)) v(token, cnt, id)"


def _doc_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.words("text").alias("tok"))


@register(
    "build_vocab",
    f"""SELECT token, cnt, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id FROM ({_COUNTS_SQL})
        UNION ALL {_SPECIALS_SQL}""",
)
def build_vocab(spark, d):
    return V.build_vocab(_doc_tokens(spark, d), "tok")


_VOCAB_SQL = f"""v AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id FROM ({_COUNTS_SQL})),
        t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {Q.words('text')} AS w FROM documents)),
        i AS (SELECT doc_id, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM t LEFT JOIN v USING (token) GROUP BY doc_id),
        e AS (SELECT doc_id, {Q.words('text')} AS w, coalesce(i.ids, []::INTEGER[]) AS ids FROM documents LEFT JOIN i USING (doc_id))"""


def _encoded(spark, d) -> DataFrame:
    toks = _doc_tokens(spark, d)
    vocab = V.build_vocab(toks, "tok")
    return V.encode_ids(toks, "tok", vocab, ["doc_id"], keep=[]), vocab


def _ids_text(c) -> Column:
    return F.array_join(F.transform(c, lambda i: i.cast("string")), " ")


@register(
    "encode_ids",
    f"""WITH {_VOCAB_SQL}
        SELECT doc_id, len(ids)::BIGINT AS n_ids, len(list_filter(ids, lambda i: i = 3))::BIGINT AS n_unk,
               array_to_string(ids, ' ') AS ids_text FROM e""",
)
def encode_ids(spark, d):
    enc, _ = _encoded(spark, d)
    return enc.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i == V.UNK)).cast("long").alias("n_unk"),
        _ids_text("ids").alias("ids_text"),
    )


@register(
    "decode_ids",
    f"""WITH {_VOCAB_SQL}
        SELECT doc_id, array_to_string(w, ' ') AS text FROM e""",
)
def decode_ids(spark, d):
    enc, vocab = _encoded(spark, d)
    return V.decode_ids(enc, "ids", vocab, ["doc_id"], out="text", keep=[]).select("doc_id", "text")


def _fit_sql(x: str, max_len: int, pad: int) -> str:
    body = f"list_concat({x}[1:{max_len - 1}], [2])"
    return f"list_concat({body}, list_transform(range({max_len} - len({body})), lambda i: {pad}))"


@register(
    "pack_examples",
    f"""WITH {_VOCAB_SQL}
        SELECT doc_id, array_to_string({_fit_sql('ids', 128, 1)}, ' ') AS input_ids,
               least(len(ids) + 1, 128)::BIGINT AS n_attention,
               array_to_string({_fit_sql('list_reverse(ids)', 128, -100)}, ' ') AS labels FROM e""",
)
def pack_examples(spark, d):
    enc, _ = _encoded(spark, d)
    packed = V.pack_examples(enc.withColumn("rids", F.reverse("ids")), "ids", "rids", max_len=128)
    return packed.select(
        "doc_id",
        _ids_text("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attention"),
        _ids_text("labels").alias("labels"),
    )


@register(
    "unmask_labels",
    f"""WITH {_VOCAB_SQL}
        SELECT doc_id, array_to_string({_fit_sql('list_reverse(ids)', 128, 1)}, ' ') AS labels FROM e""",
)
def unmask_labels(spark, d):
    enc, _ = _encoded(spark, d)
    packed = V.pack_examples(enc.withColumn("rids", F.reverse("ids")), "ids", "rids", max_len=128)
    return V.unmask_labels(packed, "labels").select("doc_id", _ids_text("labels").alias("labels"))


@register(
    "decode_labels",
    f"""SELECT doc_id, array_to_string(list_reverse({Q.words('text')})[1:127], ' ') AS text FROM documents""",
)
def decode_labels(spark, d):
    """P4 -> P6 -> J3: the text of label ids that were cut to 128 places, padded and masked."""
    enc, vocab = _encoded(spark, d)
    packed = V.pack_examples(enc.withColumn("rids", F.reverse("ids")), "ids", "rids", max_len=128)
    return V.decode_labels(packed.select("doc_id", "labels"), vocab, ["doc_id"], keep=[]).select("doc_id", "text")


@register(
    "pad_to_batch_max",
    f"""WITH {_VOCAB_SQL},
        b AS (SELECT doc_id, len(ids) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM e)
        SELECT doc_id, batch_id::BIGINT AS batch_id, max(n) OVER (PARTITION BY batch_id)::BIGINT AS batch_len,
               (max(n) OVER (PARTITION BY batch_id) - n)::BIGINT AS n_pad FROM b""",
)
def pad_to_batch_max(spark, d):
    enc, _ = _encoded(spark, d)
    enc = dense_index(materialize(enc, "encoded"), ["doc_id"], name="idx")
    b = S.assign_batches(enc, 16)
    padded = V.pad_to_batch_max(b, "ids", "batch_id", out="padded")
    return padded.select(
        "doc_id", "batch_id", "batch_len", F.size(F.filter("padded", lambda i: i == V.PAD)).cast("long").alias("n_pad")
    )


# --- P7, W1, W2 --------------------------------------------------------------------


@register(
    "drop_invalid_size",
    f"""SELECT conv_id, turn FROM ({_CONV_PAIRS_SQL})
        WHERE len({Q.words('src')}) BETWEEN 2 AND 200 AND len({Q.words('tgt')}) BETWEEN 2 AND 200""",
)
def drop_invalid_size(spark, d):
    drop = TJ.drop_invalid_size

    return drop(conversation_pairs(spark, d), ("src", "tgt"), 2, 200).select("conv_id", "turn")


@register(
    "assign_batches",
    f"""SELECT conv_id, turn, idx, idx // 8 AS batch_id FROM (
          SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx FROM ({_CONV_PAIRS_SQL}))""",
)
def assign_batches(spark, d):
    pairs = dense_index(conversation_pairs(spark, d).select("conv_id", "turn"), ["conv_id", "turn"], name="idx")
    return S.assign_batches(pairs, 8).select("conv_id", "turn", "idx", "batch_id")


@register(
    "token_budget_batches",
    f"""SELECT doc_id, n_words, bucket, ((row_number() OVER (PARTITION BY bucket ORDER BY n_words, doc_id) - 1)
               // greatest(1, floor(4096 / ((bucket + 1) * 64)))::BIGINT)::BIGINT AS batch_in_bucket FROM (
          SELECT doc_id, n_words, ((greatest(n_words, 1) - 1) // 64)::BIGINT AS bucket FROM (
            SELECT doc_id, len({Q.words('text')})::BIGINT AS n_words FROM documents))""",
)
def token_budget_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(T.words("text")).cast("long").alias("n_words"))
    out = S.token_budget_batches(docs, "n_words", 4096, idx="doc_id", bucket_width=64, over="single")
    return out.select("doc_id", "n_words", "bucket", "batch_in_bucket")


@register(
    "fill_token_budget",
    f"""WITH RECURSIVE d AS (SELECT doc_id, lang, len({Q.words('text')})::BIGINT AS n_words FROM documents),
        o AS (SELECT doc_id, lang, greatest(n_words, 1) AS n, row_number() OVER (PARTITION BY lang ORDER BY greatest(n_words, 1), doc_id) AS k FROM d WHERE n_words <= 4096),
        r AS (SELECT doc_id, lang, k, 0::BIGINT AS batch_id, 1::BIGINT AS held FROM o WHERE k = 1
              UNION ALL SELECT o.doc_id, o.lang, o.k, r.batch_id + CASE WHEN (r.held + 1) * o.n <= 4096 THEN 0 ELSE 1 END, CASE WHEN (r.held + 1) * o.n <= 4096 THEN r.held + 1 ELSE 1 END
              FROM r JOIN o ON o.lang = r.lang AND o.k = r.k + 1)
        SELECT d.doc_id, d.lang, n_words, batch_id FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
)
def fill_token_budget(spark, d):
    """The exact filling by language; documents over the budget have no batch."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.size(T.words("text")).cast("long").alias("n_words"))
    docs = materialize(docs, "lengths")  # read several times below
    return S.fill_token_budget(docs, "n_words", 4096, idx="doc_id", by=["lang"], over="null")


# --- S5/J4: generation logs -----------------------------------------------------------

import uuid  # noqa: E402

from transpark.session import checkpoint_dir  # noqa: E402
from transpark.sources.genlog import parse_generation_log, read_generation_log  # noqa: E402


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tp-{name}-{uuid.uuid4().hex}"



def generation_log_lines(spark, d) -> DataFrame:
    """Log lines derived from documents: S = text, T = reversed words, H = score + text
    without every 7th word, plus D/P lines that the parser must drop."""
    docs = table(spark, d, "documents")
    w = T.words("text")
    sid = F.col("doc_id").cast("string")
    score = F.concat(F.lit("-0."), F.lpad((F.col("n_chars") % 997).cast("string"), 3, "0"))
    hyp = F.array_join(F.filter(w, lambda x, i: i % 7 != 6), " ")
    lines = F.array(
        F.concat(F.lit("H-"), sid, F.lit("\t"), score, F.lit("\t"), hyp),
        F.concat(F.lit("D-"), sid, F.lit("\t"), score, F.lit("\t"), hyp),
        F.concat(F.lit("T-"), sid, F.lit("\t"), F.array_join(F.reverse(w), " ")),
        F.concat(F.lit("P-"), sid, F.lit("\t-0.1 -0.2")),
        F.concat(F.lit("S-"), sid, F.lit("\t"), F.array_join(w, " ")),
    )
    return docs.select(F.explode(lines).alias("value"))


_LOG_LINES_SQL = f"""SELECT unnest([
      'H-' || doc_id || chr(9) || sc || chr(9) || hyp,
      'D-' || doc_id || chr(9) || sc || chr(9) || hyp,
      'T-' || doc_id || chr(9) || array_to_string(list_reverse(w), ' '),
      'P-' || doc_id || chr(9) || '-0.1 -0.2',
      'S-' || doc_id || chr(9) || array_to_string(w, ' ')]) AS value
    FROM (SELECT doc_id, w, '-0.' || lpad((n_chars % 997)::VARCHAR, 3, '0') AS sc,
                 array_to_string(list_filter(w, lambda x, i: (i - 1) % 7 <> 6), ' ') AS hyp
          FROM (SELECT doc_id, n_chars, {Q.words('text')} AS w FROM documents))"""


@register(
    "generation_log",
    f"""WITH l AS ({_LOG_LINES_SQL}),
        t AS (SELECT regexp_extract(value, '^([STH])-([0-9]+)\\t(.*)$', 1) AS tag,
                     regexp_extract(value, '^([STH])-([0-9]+)\\t(.*)$', 2) AS id,
                     regexp_extract(value, '^([STH])-([0-9]+)\\t(.*)$', 3) AS body FROM l)
        SELECT id::BIGINT AS id,
               max(CASE WHEN tag = 'S' THEN body END) AS src,
               max(CASE WHEN tag = 'T' THEN body END) AS ref,
               max(CASE WHEN tag = 'H' THEN regexp_extract(body, '^([^\\t]*)\\t(.*)$', 2) END) AS hyp,
               max(CASE WHEN tag = 'H' THEN regexp_extract(body, '^([^\\t]*)\\t(.*)$', 1)::DOUBLE END) AS score
        FROM t WHERE tag <> '' GROUP BY id""",
)
def generation_log(spark, d):
    return parse_generation_log(generation_log_lines(spark, d))


_ODD = "\u0085\u2028"  # characters that some readers take for line ends


@register(
    "generation_log_files",
    f"""SELECT split, doc_id AS id, array_to_string(w, chr(133) || chr(8232)) AS src, array_to_string(list_reverse(w), ' ') AS ref,
               CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE array_to_string(w, ' ') END AS hyp, -0.25::DOUBLE AS score, 2::BIGINT AS n_hyps
        FROM (SELECT doc_id, doc_id % 3 AS split, {Q.words('text')} AS w FROM documents)""",
)
def generation_log_files(spark, d):
    """S5 from files: three logs with two hypotheses for every id, texts with U+0085 and U+2028 in them."""
    docs = table(spark, d, "documents")
    w, sid = T.words("text"), F.col("doc_id").cast("string")
    plain = F.array_join(w, " ")
    first, second = F.when(F.col("doc_id") % 2 == 0, "-0.5").otherwise("-0.25"), F.when(F.col("doc_id") % 2 == 0, "-0.25").otherwise("-0.5")
    lines = F.array(
        F.concat(F.lit("H-"), sid, F.lit("\t"), first, F.lit("\t"), plain),
        F.concat(F.lit("H-"), sid, F.lit("\t"), second, F.lit("\tsecond")),
        F.concat(F.lit("T-"), sid, F.lit("\t"), F.array_join(F.reverse(w), " ")),
        F.concat(F.lit("S-"), sid, F.lit("\t"), F.array_join(w, _ODD)),
    )
    out = _scratch(spark, "genlog")
    # documents are sorted by log as they are, not as the four texts that are made of each
    docs = docs.withColumn("log", F.col("doc_id") % 3).sortWithinPartitions("log")
    docs.select("log", F.array_join(lines, "\n").alias("value")).write.partitionBy("log").option("compression", "gzip").text(out)
    got = read_generation_log(spark, f"{out}/log=*", n_best=True)
    split = F.regexp_extract("log", "log=([0-9]+)", 1).cast("long")
    return got.select(split.alias("split"), "id", "src", "ref", "hyp", "score", F.size("hyps").cast("long").alias("n_hyps"))


# --- P8-P13: text jobs -------------------------------------------------------------------

from transpark.functions import rules as RL  # noqa: E402


def _sql_rules(x: str, rules) -> str:
    for pattern, repl in rules:
        r = re.sub(r"\$([0-9])", r"\\\1", repl).replace("'", "''")
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{r}', 'g')"
    return x


def _sql_escape(x: str) -> str:
    for a, b in RL.ESCAPE:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return x


def _sql_unescape_basic(x: str) -> str:
    for a, b in reversed(RL.ESCAPE):
        x = f"replace({x}, '{b}', '{a.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_quoted(x: str) -> str:
    for mark, quote in (('"', '"'), (RL.QUOTE, "''")):
        x = f"array_to_string(list_transform(string_split({x}, '{mark}'), lambda p, i: CASE WHEN i % 2 = 0 THEN trim(p) ELSE p END), '{quote}')"
    return x


@register("normalize_docs", f"SELECT doc_id, {_sql_rules('text', RL.normalize_rules('en'))} AS text FROM documents")
def normalize_docs(spark, d):
    return TJ.normalize_corpus(table(spark, d, "documents"), "text").select("doc_id", "text")


_TOK_SQL = _sql_escape(_sql_rules("text", RL.tokenize_rules("en")))


@register("tokenize_docs", f"SELECT doc_id, {_TOK_SQL} AS text FROM documents")
def tokenize_docs(spark, d):
    return TJ.tokenize_corpus(table(spark, d, "documents"), "text").select("doc_id", "text")


@register(
    "detokenize_docs",
    f"SELECT doc_id, {_sql_quoted(_sql_rules(_sql_unescape_basic(_TOK_SQL), RL.DETOKENIZE))} AS text FROM documents",
)
def detokenize_docs(spark, d):
    tok = TJ.tokenize_corpus(table(spark, d, "documents"), "text")
    return TJ.detokenize_corpus(tok, "text").select("doc_id", "text")


@register("join_pieces", f"SELECT doc_id, array_to_string({Q.words('text')}, ' ') AS text FROM documents")
def join_pieces(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.fixed_pieces("text", 3).alias("pieces"))
    return TJ.join_pieces_corpus(docs, "pieces", out="text").select("doc_id", "text")


@register("strip_lines", f"SELECT doc_id, line_no, {Q.strip('line')} AS line FROM ({_LINES_SQL})")
def strip_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines("text")).alias("line_no", "line"))
    return TJ.strip_lines(docs.withColumn("line_no", F.col("line_no").cast("long")), "line").select("doc_id", "line_no", "line")


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _unescape_pages_sql() -> str:
    html5 = ", ".join(f"{_sql_str(k)}: {_sql_str(v)}" for k, v in sorted(T._HTML5.items()))
    legacy = ", ".join(f"{_sql_str(k)}: {_sql_str(v)}" for k, v in sorted(T._LEGACY.items()))
    remap = ", ".join(f"{k}: {_sql_str(v)}" for k, v in sorted(T._REMAPPED.items()))
    dropped = ", ".join(str(x) for x in T._DROPPED)

    def num_char(d: str, hexa: bool) -> str:
        num = f"(CASE WHEN {d} = '' THEN 0 WHEN length({d}) > 8 THEN NULL ELSE " + (
            f"('0x' || {d})::BIGINT END)" if hexa else f"{d}::BIGINT END)"
        )
        return (
            f"(CASE WHEN length({d}) <= 8 AND rm[{num}] IS NOT NULL THEN rm[{num}] "
            f"WHEN length({d}) > 8 OR {num} > 1114111 OR ({num} >= 55296 AND {num} <= 57343) THEN chr(65533) "
            f"WHEN {num} IN ({dropped}) THEN '' ELSE chr({num}::INTEGER) END)"
        )

    b = "refs[i]"
    digits = f"regexp_replace({b}, ';$', '')"
    hex_d = f"regexp_replace(substr({digits}, 3), '^0+', '')"
    dec_d = f"regexp_replace(substr({digits}, 2), '^0+', '')"
    prefixes = ", ".join(
        f"(CASE WHEN length({b}) - 1 >= {x} THEN lm[substr({b}, 1, {x})] || substr({b}, {x + 1}) END)"
        for x in range(T._LEGACY_MAX, 1, -1)
    )
    dec = (
        f"CASE WHEN {b} IS NULL THEN '' "
        f"WHEN lower(substr({b}, 1, 2)) = '#x' THEN {num_char(hex_d, True)} "
        f"WHEN substr({b}, 1, 1) = '#' THEN {num_char(dec_d, False)} "
        f"ELSE coalesce(m[{b}], {prefixes}, '&' || {b}) END"
    )
    ent = T.ENTITY
    return f"""WITH em AS (SELECT MAP {{{html5}}} AS m, MAP {{{legacy}}} AS lm, MAP {{{remap}}} AS rm),
        p AS (SELECT page_id, html, string_split_regex(html, '{ent}') AS parts,
                     regexp_extract_all(html, '{ent}', 1) AS refs FROM pages)
        SELECT page_id, CASE WHEN instr(html, '&') > 0
               THEN array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(({dec}), '')), '')
               ELSE html END AS text
        FROM p, em"""


@register("unescape_pages", _unescape_pages_sql())
def unescape_pages(spark, d):
    return TJ.unescape_corpus(table(spark, d, "pages"), "html", out="text").select("page_id", "text")


# --- M1-M3, A8: dataset assembly ---------------------------------------------------------

from transpark.operators import assembly as M  # noqa: E402


def _synthetic_pairs(spark, d) -> DataFrame:
    """Back-translation stand-in from documents: the shortened text plays the model output (hyp)."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("src"),
        F.array_join(F.filter(T.words("text"), lambda x, i: i % 7 != 6), " ").alias("hyp"),
    )
    return M.swap_roles(docs)


def _real_pairs(spark, d) -> DataFrame:
    pairs = conversation_pairs(spark, d)
    pairs = number_by_key(pairs, ["conv_id", "turn"])
    split = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "dev").otherwise("train")
    return pairs.select("idx", "src", "tgt", split.alias("split"))


_SYN_SQL = f"""SELECT doc_id AS idx, array_to_string(list_filter({Q.words('text')}, lambda x, i: (i - 1) % 7 <> 6), ' ') AS src,
       text AS tgt FROM documents"""
_REAL_SQL = f"""SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx, src, tgt,
       CASE WHEN conv_id % 10 = 0 THEN 'test' WHEN conv_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split
    FROM ({_CONV_PAIRS_SQL})"""


@register(
    "mix_corpora",
    f"""SELECT origin, (row_number() OVER (ORDER BY o, orig_idx) - 1)::BIGINT AS idx, orig_idx, src, tgt FROM (
          SELECT 'real' AS origin, 0 AS o, idx AS orig_idx, src, tgt FROM ({_REAL_SQL}) WHERE split = 'train'
          UNION ALL SELECT 'synthetic', 1, idx, src, tgt FROM ({_SYN_SQL}))""",
)
def mix_corpora(spark, d):
    real = _real_pairs(spark, d).filter(F.col("split") == "train").select("idx", "src", "tgt")
    syn = _synthetic_pairs(spark, d).select("idx", "src", "tgt")
    out = M.mix_corpora({"real": real, "synthetic": syn})
    return out.select("origin", "idx", "orig_idx", "src", "tgt")


@register(
    "with_eval_splits",
    f"""SELECT 'train' AS split, idx, src, tgt FROM ({_SYN_SQL})
        UNION ALL SELECT split, idx, src, tgt FROM ({_REAL_SQL}) WHERE split <> 'train'""",
)
def with_eval_splits(spark, d):
    syn = _synthetic_pairs(spark, d).select("idx", "src", "tgt")
    return M.with_eval_splits(syn, _real_pairs(spark, d)).select("split", "idx", "src", "tgt")


@register(
    "dataset_sizes",
    f"""SELECT dataset, split, count(*)::BIGINT AS rows FROM (
          SELECT 'bt' AS dataset, 'train' AS split FROM documents
          UNION ALL SELECT 'bt', split FROM ({_REAL_SQL}) WHERE split <> 'train'
          UNION ALL SELECT 'base', split FROM ({_REAL_SQL})) GROUP BY ALL""",
)
def dataset_sizes(spark, d):
    # only what is counted is read: neither text nor line numbers
    split = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "dev").otherwise("train")
    real = conversation_pairs(spark, d).select(split.alias("split"))
    bt = M.with_eval_splits(table(spark, d, "documents").select(F.lit("train").alias("split")), real)
    return M.dataset_sizes(bt.withColumn("dataset", F.lit("bt")).unionByName(real.withColumn("dataset", F.lit("base"))))


# --- A9-A12: results over many runs (events as a metric log) ----------------------------------

from transpark.operators import runs as RN  # noqa: E402

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _event_scores(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("column")).agg(
        r6(F.avg("value")).alias("mean")
    )


_SCORES_SQL = f"SELECT user_id AS model, event_type AS \"column\", {Q.r6('avg(value)')} AS mean FROM events GROUP BY ALL"


@register(
    "compare_runs",
    "SELECT model, " + ", ".join(f"max(CASE WHEN \"column\" = '{c}' THEN mean END) AS {c}" for c in EVENT_TYPES)
    + f" FROM ({_SCORES_SQL}) GROUP BY model",
)
def compare_runs(spark, d):
    return RN.compare_runs(_event_scores(spark, d), EVENT_TYPES).select("model", *EVENT_TYPES)


@register(
    "best_per_column",
    f"""SELECT model, "column", mean, mean = max(mean) OVER (PARTITION BY "column") AS is_best FROM ({_SCORES_SQL})""",
)
def best_per_column(spark, d):
    return RN.best_per_column(_event_scores(spark, d)).select("model", "column", "mean", "is_best")


def _metric_log(spark, d) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    return dense_index(ev, ["ts", "event_id"], partition_by=["run"], name="step")


_LOG_SQL = """SELECT user_id AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step, value
    FROM events"""


@register(
    "best_checkpoint",
    f"""SELECT run, step AS best_step, value AS best_value FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS r FROM ({_LOG_SQL})) WHERE r = 1""",
)
def best_checkpoint(spark, d):
    return RN.best_checkpoint(_metric_log(spark, d), "run", "step", "value")


@register(
    "best_checkpoints",
    f"""SELECT run, r AS rank, step, value FROM (
          SELECT *, (row_number() OVER (PARTITION BY run ORDER BY value DESC, step))::INTEGER AS r FROM ({_LOG_SQL})) WHERE r <= 3""",
)
def best_checkpoints(spark, d):
    """The three best steps of every run."""
    return RN.best_checkpoints(_metric_log(spark, d), 3, "run", "step", "value")


@register(
    "early_stop_sparse",
    f"""WITH l AS (SELECT run, step * step * 10 AS step, value, step AS k FROM ({_LOG_SQL})),
        a AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY k) AS top FROM l),
        f AS (SELECT run, value, min(k) AS first FROM l GROUP BY run, value),
        s AS (SELECT a.run, min(a.k) AS stop FROM a JOIN f ON f.run = a.run AND f.value = a.top WHERE a.k - f.first >= 8 GROUP BY a.run),
        b AS (SELECT l.*, s.stop, row_number() OVER (PARTITION BY l.run ORDER BY value DESC, k) AS r FROM l LEFT JOIN s USING (run) WHERE s.stop IS NULL OR k <= s.stop)
        SELECT b.run, l.step AS stop_step, b.step AS best_step, b.value AS best_value FROM b LEFT JOIN l ON l.run = b.run AND l.k = b.stop WHERE r = 1""",
)
def early_stop_sparse(spark, d):
    """A12 over steps that lie apart: validations are counted, not steps."""
    log = _metric_log(spark, d).withColumn("step", F.col("step") * F.col("step") * 10)
    return RN.early_stop_point(log, 8, "run", "step", "value").select("run", "stop_step", "best_step", "best_value")


@register(
    "early_stop_point",
    f"""WITH l AS ({_LOG_SQL}),
        a AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
        b AS (SELECT *, before IS NULL OR value > before AS imp FROM a),
        c AS (SELECT *, max(CASE WHEN imp THEN step END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM b),
        s AS (SELECT run, min(CASE WHEN step - last_imp >= 50 THEN step END) AS stop_step FROM c GROUP BY run),
        k AS (SELECT l.run, l.step, l.value, s.stop_step FROM l JOIN s USING (run) WHERE s.stop_step IS NULL OR l.step <= s.stop_step)
        SELECT run, stop_step, step AS best_step, value AS best_value FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS r FROM k) WHERE r = 1""",
)
def early_stop_point(spark, d):
    return RN.early_stop_point(_metric_log(spark, d), 50, "run", "step", "value").select(
        "run", "stop_step", "best_step", "best_value"
    )


# --- U1-U3, A7: pluggable batch functions -----------------------------------------------------

from transpark.operators import udf as U  # noqa: E402


@register(
    "translate_corpus",
    f"SELECT doc_id, array_to_string(list_reverse({Q.words('text')}), ' ') AS hyp FROM documents",
)
def translate_corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return U.translate_corpus(docs, U.reverse_words_translator, "text", "hyp", batch_size=32).select("doc_id", "hyp")


@register(
    "teacher_translate",
    f"SELECT doc_id, array_to_string(list_reverse({Q.words('text')}), ' ') AS hyp FROM documents",
)
def teacher_translate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return U.teacher_translate(docs, U.escaping_reverse_translator, "text", "hyp", batch_size=100).select("doc_id", "hyp")


@register(
    "segment_score_summary",
    f"""SELECT lang, {Q.r6('avg(sc) * 100.0::DOUBLE')} AS score_mean, {Q.r6('stddev_samp(sc) * 100.0::DOUBLE')} AS score_std,
               count(*)::BIGINT AS segments FROM (
          SELECT lang, CASE WHEN len(list_distinct(r)) = 0 THEN 0.0::DOUBLE
                 ELSE len(list_intersect(list_distinct(h), list_distinct(r))) / len(list_distinct(r)) END AS sc
          FROM (SELECT lang, {Q.words('hyp')} AS h, {Q.words('ref')} AS r FROM ({_DOC_PAIRS_SQL})))
        GROUP BY lang""",
)
def segment_score_summary(spark, d):
    pairs = table(spark, d, "documents").select(
        "lang",
        F.col("text").alias("src"),
        F.array_join(F.filter(T.words("text"), lambda w, i: i % 7 != 6), " ").alias("hyp"),
        F.col("text").alias("ref"),
    )
    scored = U.score_segments(pairs, U.overlap_scorer)
    out = RN.segment_score_summary(scored, "seg_score", ["lang"])
    return out.select("lang", r6("score_mean").alias("score_mean"), r6("score_std").alias("score_std"), "segments")


@register(
    "shuffle_rows",
    """SELECT (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1)::BIGINT AS pos, doc_id AS idx FROM documents""",
)
def shuffle_rows(spark, d):
    """T4: the shuffled ids exported in order and read back with their line numbers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    out = _scratch(spark, "shuffled")
    S.shuffle_rows(docs, 42).select(F.col("idx").cast("string").alias("value")).write.text(out)
    return _read_lines(spark, out).select(F.col("idx").alias("pos"), F.col("text").cast("long").alias("idx"))


# --- F2, F4: compositions ---------------------------------------------------------------------

from transpark.plans import workflows as WF  # noqa: E402


@register(
    "back_translate",
    f"""SELECT 'train' AS split, doc_id AS idx, array_to_string(list_reverse({Q.words('text')}), ' ') AS src, text AS tgt FROM documents
        UNION ALL SELECT split, idx, src, tgt FROM ({_REAL_SQL}) WHERE split <> 'train'""",
)
def back_translate(spark, d):
    mono = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    out = WF.back_translate(mono, U.reverse_words_translator, base=_real_pairs(spark, d))
    return out.select("split", "idx", "src", "tgt")


@register(
    "back_translate_mixed",
    f"""WITH syn AS (SELECT doc_id AS orig_idx, array_to_string(list_reverse({Q.words('text')}), ' ') AS src, text AS tgt,
                            {Q.ttr_of(f"list_reverse({Q.words('text')})")} AS ttr FROM documents),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ttr DESC NULLS LAST, orig_idx) AS rn, count(*) OVER () AS n FROM syn)
                WHERE rn <= trunc(n * 0.4::DOUBLE)),
        mix AS (SELECT 'real' AS origin, 0 AS o, idx AS orig_idx, src, tgt FROM ({_REAL_SQL}) WHERE split = 'train'
                UNION ALL SELECT 'synthetic', 1, orig_idx, src, tgt FROM top)
        SELECT 'train' AS split, origin, (row_number() OVER (ORDER BY o, orig_idx) - 1)::BIGINT AS idx, src, tgt FROM mix
        UNION ALL SELECT split, NULL, idx, src, tgt FROM ({_REAL_SQL}) WHERE split <> 'train'""",
)
def back_translate_mixed(spark, d):
    """F2 with selection of the most diverse pairs and the base training pairs mixed in."""
    mono = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    out = WF.back_translate(mono, U.reverse_words_translator, base=_real_pairs(spark, d), select_fraction=0.4, mix_with_base=True)
    return out.select("split", "origin", "idx", "src", "tgt")


@register(
    "evaluate_runs",
    f"""{_BATCH_SCORES},
        c AS (SELECT lang, {Q.r6(Q.bleu_raw())} AS test_bleu FROM (SELECT lang, {Q.sums()} FROM seg GROUP BY lang)),
        m AS (SELECT lang, {Q.r6('avg(bleu)')} AS test_bleu_b32 FROM b GROUP BY lang)
        SELECT lang AS model, test_bleu, test_bleu_b32 FROM c JOIN m USING (lang)""",
)
def evaluate_runs(spark, d):
    segs = doc_pairs(spark, d).select(F.col("lang").alias("run"), "idx", F.col("ref").alias("src"), "ref", "hyp")
    # (the run segments arrive numbered, as stored outputs are)
    res = WF.evaluate_runs(segs, 32)
    return res["table"].select("model", r6("test_bleu").alias("test_bleu"), r6("test_bleu_b32").alias("test_bleu_b32"))


def _read_back(spark, out: str) -> DataFrame:
    """The segments of an export's text files. ``read_segments`` stores the lines as it reads them, so the scratch files
    go: the Parquet copy, which is not read back, before that and the texts after it."""
    delete(spark, f"{out}/parquet")
    back = _read_segments(spark, out)
    delete(spark, out)
    return back


@register(
    "evaluate_runs_files",
    f"""{_BATCH_SCORES},
        c AS (SELECT lang, {Q.bleu_raw()} AS v, NULL::DOUBLE AS sd FROM (SELECT lang, {Q.sums()} FROM seg GROUP BY lang)),
        m AS (SELECT lang, avg(bleu) AS v, stddev_samp(bleu) AS sd FROM b GROUP BY lang),
        gs AS (SELECT lang, avg(sc) * 100.0::DOUBLE AS v, stddev_samp(sc) * 100.0::DOUBLE AS sd FROM (
                SELECT lang, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(h, r)) / len(r) END AS sc FROM (
                  SELECT lang, list_distinct({Q.words('hyp')}) AS h, list_distinct({Q.words('ref')}) AS r FROM ({_DOC_PAIRS_SQL}))) GROUP BY lang),
        l AS (SELECT lang, 'bleu' AS metric, v, sd FROM c UNION ALL SELECT lang, 'bleu_b32', v, sd FROM m UNION ALL SELECT lang, 'score', v, sd FROM gs)
        SELECT lang AS model, metric, {Q.r6('v')} AS mean, {Q.r6('sd')} AS stdev, v = max(v) OVER (PARTITION BY metric) AS is_best FROM l""",
)
def evaluate_runs_files(spark, d):
    """F4 as a whole: stored text files (K1, S4) -> BLEU and learned score per run -> run log (K2) and best flags."""
    out, log = _scratch(spark, "runs"), _scratch(spark, "evallog")
    with temporary(spark):
        segs = doc_pairs(spark, d).select(F.col("lang").alias("run"), "idx", T.squeeze("ref").alias("src"), T.squeeze("ref").alias("ref"), "hyp")
        K.write_segments(segs, out, text_export=True)
    res = WF.evaluate_runs(_read_back(spark, out), 32, make_scorer=U.overlap_scorer, log_path=log)
    flags = res["best"].select("model", "metric", "is_best")
    return spark.read.parquet(log).join(flags, ["model", "metric"]).select("model", "metric", r6("mean").alias("mean"), r6("stdev").alias("stdev"), "is_best")


# --- F1: corpus preparation -----------------------------------------------------------------------


def _prep_col_sql(col: str) -> str:
    return _sql_escape(_sql_rules(_sql_rules(col, RL.normalize_rules('en')), RL.tokenize_rules("en")))


@register(
    "prepare_corpus",
    f"""WITH p AS (SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx,
                          {_prep_col_sql('src')} AS src_tok, {_prep_col_sql('tgt')} AS tgt_tok FROM ({_CONV_PAIRS_SQL})),
        w AS (SELECT idx, src_tok, tgt_tok, {Q.words('src_tok')} AS sw, {Q.words('tgt_tok')} AS tw FROM p),
        vs AS (SELECT map_from_entries(list((token, id))) AS m FROM (
                 SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id FROM (
                   SELECT token, count(*) AS cnt FROM (SELECT unnest(sw) AS token FROM w) GROUP BY token))),
        vt AS (SELECT map_from_entries(list((token, id))) AS m FROM (
                 SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id FROM (
                   SELECT token, count(*) AS cnt FROM (SELECT unnest(tw) AS token FROM w) GROUP BY token)))
        SELECT idx, src_tok, tgt_tok,
               array_to_string(list_transform(sw, lambda x: vs.m[x]), ' ') AS src_ids,
               array_to_string(list_transform(tw, lambda x: vt.m[x]), ' ') AS tgt_ids
        FROM w, vs, vt""",
)
def prepare_corpus(spark, d):
    pairs = number_by_key(conversation_pairs(spark, d), ["conv_id", "turn"]).select("idx", "src", "tgt")
    out, _ = WF.prepare_corpus(pairs, key=["idx"])
    return out.select("idx", "src_tok", "tgt_tok", _ids_text("src_ids").alias("src_ids"), _ids_text("tgt_ids").alias("tgt_ids"))


def _drop_every(k: int):
    """A toy model with one fitted parameter: it leaves out every k-th word."""

    def make():
        return lambda texts: [" ".join(w for i, w in enumerate(t.split()) if i % k != k - 1) for t in texts]

    return make


def _bt_round_sql(r: int, k: str) -> str:
    kept = lambda c: f"array_to_string(list_filter({Q.words(c)}, lambda x, i: (i - 1) % {k} <> {k} - 1), ' ')"
    return f"""d{r} AS MATERIALIZED (SELECT doc_id AS idx, {kept('text')} AS short, text AS full_text FROM documents, k{r}),
        p{r} AS MATERIALIZED (SELECT 'conv' AS run, idx, {kept('src')} AS hyp, tgt AS ref
                 FROM (SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx, src, tgt FROM ({_CONV_PAIRS_SQL})), k{r})"""


def _bt_bleu_sql(r: int) -> str:
    return f"""SELECT {Q.r6('avg(bleu)')} AS dev_bleu FROM (
        WITH {Q.segment_stats(f'SELECT * FROM p{r}', ['run', 'idx'])},
        s AS (SELECT (idx // 32)::BIGINT AS batch_id, {Q.sums()} FROM seg GROUP BY ALL)
        SELECT {Q.bleu_raw()} AS bleu FROM s)"""


@register(
    "iterate_back_translation",
    f"""WITH k0 AS (SELECT 2 AS k), {_bt_round_sql(0, 'k')},
        k1 AS (SELECT 3 + sum(len({Q.words('short')}) + len({Q.words('full_text')})) % 7 AS k FROM d0), {_bt_round_sql(1, 'k')},
        k2 AS (SELECT 3 + sum(len({Q.words('short')}) + len({Q.words('full_text')})) % 7 AS k FROM d1), {_bt_round_sql(2, 'k')},
        b0 AS ({_bt_bleu_sql(0)}), b1 AS ({_bt_bleu_sql(1)}), b2 AS ({_bt_bleu_sql(2)})
        """
    + " UNION ALL ".join(
        f"""SELECT {r} AS "round", 'bt' AS direction, 'train' AS split, idx, short AS src, full_text AS tgt, dev_bleu FROM d{r}, b{r}
            UNION ALL SELECT {r}, 'ft', 'train', idx, full_text, short, dev_bleu FROM d{r}, b{r}"""
        for r in range(3)
    ),
)
def iterate_back_translation(spark, d):
    """three rounds over all documents (both directions) scored on the conversation pairs; the model of a
    round is fitted on the data of the round before (its number of words)."""
    mono = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    pairs = conversation_pairs(spark, d)
    dev = number_by_key(pairs, ["conv_id", "turn"])

    def fit(r, previous):
        n = 0 if previous is None else previous.filter("direction = 'bt'").agg(F.sum(F.size(T.words("src")) + F.size(T.words("tgt")))).first()[0]
        model = _drop_every(2 if previous is None else 3 + n % 7)
        return model, model

    dev = dev.select("idx", "src", "tgt")
    out, scores = WF.iterate_back_translation(mono, mono, fit, dev, rounds=3, stop_eps=None, together=True)
    score = F.get(F.array(*[F.lit(float(x)) for x in scores]), F.col("round"))
    out = out.withColumn("dev_bleu", r6(score))
    return out.select("round", "direction", "split", "idx", "src", "tgt", "dev_bleu")


# --- S1/K3 and K1/S4: text files written from the tables and read back ------------------------------

from transpark.sources import sinks as K  # noqa: E402
from transpark.sources.text_files import read_lines as _read_lines, read_segments as _read_segments  # noqa: E402


@register(
    "read_lines",
    f"""SELECT (doc_id % 16)::BIGINT AS bucket,
               (row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, line_no) - 1)::BIGINT AS idx, line AS text
        FROM ({_LINES_SQL})""",
)
def read_lines_query(spark, d):
    """Document lines exported as text files (16 folders by doc_id % 16, lines in (doc_id, line_no)
    order across the part files), then read back with exact line numbers per folder."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines("text")).alias("line_no", "line"))
    lines = lines.withColumn("bucket", F.col("doc_id") % 16)
    out = _scratch(spark, "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        lines.repartitionByRange(n, "bucket", "doc_id", "line_no")
        .sortWithinPartitions("bucket", "doc_id", "line_no")
        .select("bucket", F.col("line").alias("value"))
        .write.partitionBy("bucket")
        .text(out)
    )
    back = _read_lines(spark, f"{out}/bucket=*")
    bucket = F.regexp_extract("file", r"bucket=([0-9]+)$", 1).cast("long")
    return back.select(bucket.alias("bucket"), "idx", "text")


@register(
    "segments_round_trip",
    f"""SELECT lang AS run, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS idx,
               array_to_string({Q.words('text')}, ' ') AS src, array_to_string({Q.words('text')}, ' ') AS ref,
               array_to_string(list_filter({Q.words('text')}, lambda x, i: (i - 1) % 7 <> 6), ' ') AS hyp
        FROM documents""",
)
def segments_round_trip(spark, d):
    """K1 text export of per-language segment triples, read back with S4."""
    out = _scratch(spark, "segments")
    with temporary(spark):
        segs = doc_pairs(spark, d).select(
            F.col("lang").alias("run"), "idx", T.squeeze("ref").alias("src"), T.squeeze("ref").alias("ref"), "hyp"
        )
        K.write_segments(segs, out, text_export=True)
    return _read_back(spark, out)


from transpark.sources.text_files import read_vocab as _read_vocab  # noqa: E402


@register(
    "read_vocab",
    f"""SELECT token, cnt, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id FROM ({_COUNTS_SQL})
        UNION ALL {_SPECIALS_SQL}""",
)
def read_vocab_query(spark, d):
    """The document vocabulary written as a ``token count`` file in id order, read back with S6."""
    vocab = V.build_vocab(_doc_tokens(spark, d), "tok").filter(F.col("id") >= len(V.SPECIALS))
    out = _scratch(spark, "vocab")
    K.write_text_column(vocab.withColumn("line", F.concat_ws(" ", "token", F.col("cnt").cast("string"))), "line", out, ["id"], one_file=True)
    return _read_vocab(spark, out)


from transpark.sources.text_files import read_dataset as _read_dataset  # noqa: E402


@register(
    "read_dataset",
    f"""SELECT split, (row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1)::BIGINT AS idx,
               array_to_string({Q.words('src')}, ' ') AS src, array_to_string({Q.words('tgt')}, ' ') AS tgt
        FROM (SELECT *, CASE WHEN conv_id % 10 = 0 THEN 'test' WHEN conv_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split
              FROM ({_CONV_PAIRS_SQL}))""",
)
def read_dataset_query(spark, d):
    """Conversation pairs written as ``{split}.user`` / ``{split}.assistant`` line files (K3 text form), the
    evaluation splits copied from a base dataset, read back with S3."""
    split = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "dev").otherwise("train")
    pairs = conversation_pairs(spark, d).withColumn("split", split)
    pairs = number_by_key(pairs, ["conv_id", "turn"], partition_by=["split"])
    pairs = pairs.select("split", "idx", T.squeeze("src").alias("src"), T.squeeze("tgt").alias("tgt"))
    out = _scratch(spark, "dataset")
    K.export_dataset(pairs.filter("split = 'train'"), out, "user", "assistant", base=pairs)
    return _read_dataset(spark, out, "user", "assistant").select("split", "idx", "src", "tgt")


from transpark.sources.text_files import read_parallel as _read_parallel  # noqa: E402


@register(
    "read_parallel_strict",
    f"""SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx,
               array_to_string({Q.words('src')}, ' ') AS src, array_to_string({Q.words('tgt')}, ' ') AS tgt FROM ({_CONV_PAIRS_SQL})""",
)
def read_parallel_strict(spark, d):
    """S2 + J1: both sides of the conversation pairs written as line files and aligned by line number."""
    pairs = conversation_pairs(spark, d).select("conv_id", "turn", T.squeeze("src").alias("src"), T.squeeze("tgt").alias("tgt"))
    out = _scratch(spark, "parallel")
    K.write_text_column(pairs, "src", f"{out}/pairs.user", ["conv_id", "turn"], one_file=True)
    K.write_text_column(pairs, "tgt", f"{out}/pairs.assistant", ["conv_id", "turn"])
    return _read_parallel(spark, f"{out}/pairs", "user", "assistant").select("idx", "src", "tgt")


@register(
    "append_run_log",
    f"""WITH {Q.segment_stats(_DOC_PAIRS_SQL, ['lang', 'idx'])},
        s AS (SELECT lang, {Q.sums()} FROM seg GROUP BY lang),
        b AS (SELECT lang AS run, 'bleu' AS metric, {Q.r6(Q.bleu_raw())} AS value FROM s)
        SELECT * FROM b UNION ALL SELECT * FROM b""",
)
def append_run_log(spark, d):
    """K2: per-language corpus BLEU appended twice (two evaluation runs) to a CSV metrics log
    with headers, read back with a fixed schema."""
    scores = corpus_bleu_by_lang(spark, d).select(
        F.col("lang").alias("run"), F.lit("bleu").alias("metric"), F.col("bleu").alias("value")
    )
    log = _scratch(spark, "runlog")
    for _ in range(2):
        K.append_run_log(scores, log, fmt="csv")
    return spark.read.option("header", True).schema("run STRING, metric STRING, value DOUBLE").csv(log)


_GENLOG_SQL = ORACLE["generation_log"]


@register(
    "natural_order_export",
    f"""SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx, hyp AS text FROM ({_GENLOG_SQL})""",
)
def natural_order_export(spark, d):
    """T3 + ordered text export: hypotheses of the folded log written in numeric id order
    (a distributed range sort, no single-task sort) and read back with line numbers."""
    folded = parse_generation_log(generation_log_lines(spark, d))
    out = _scratch(spark, "hyp-export")
    S.natural_order(folded).select(K.one_line("hyp").alias("value")).write.text(out)
    return _read_lines(spark, out).select("idx", "text")


@register("write_dataset", ORACLE["with_eval_splits"])
def write_dataset_query(spark, d):
    """K3: the assembled dataset (synthetic train + base dev/test) written partitioned by split
    and read back."""
    syn = _synthetic_pairs(spark, d).select("idx", "src", "tgt")
    ds = M.with_eval_splits(syn, _real_pairs(spark, d)).select("split", "idx", "src", "tgt")
    out = _scratch(spark, "dataset-parquet")
    K.write_dataset(ds, out)
    return spark.read.parquet(out).select("split", "idx", "src", "tgt")
