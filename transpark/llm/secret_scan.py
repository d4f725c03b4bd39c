"""Secret scans in DataFrame functions alone: fixed patterns, and a battery of randomness tests.

Base spans are the matches of three fixed patterns. The battery looks at runs of at least ``LEAST``
characters of the usual key alphabets that mix digits or cases; of a run that base spans cut, at the parts
outside them. Each has the encoding of the smallest alphabet that holds it (hex in any case, base32 and
base36 in one case, base62, base64), and is tested against being random in that alphabet: chi-squared uniformity of its characters, the runs of the
lower and the upper half of the alphabet, and the serial correlation of neighbours. The least of the
three p-values, times three, must not fall below ``REJECT``. Against the other hypothesis, ordinary
text, it has a p-value from its index of coincidence and from its share of digits. Weighted
Benjamini-Hochberg control at ``RATE`` over the candidates of a document, with weights in proportion to
length, decides which of them are no text.

Everything is one projection per document: nothing moves between tasks. Positions are code points,
ends exclusive. A null text counts as empty; texts without a match have empty span lists. An empty table
gives an empty one; repeated rows and ids are scanned each on its own; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import table

LEAST = 20
RATE = 0.05  # false discoveries among the spans that the battery adds to a document
REJECT = 0.001  # a candidate less likely than this under randomness is dropped
TEXT_COINCIDENCE = 0.065  # index of coincidence of ordinary words
TEXT_DIGITS = 0.02  # share of digits in ordinary words
BLOCK = 128  # matches whose positions are summed up at a time


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""(?:{_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
_SPANS = "array<struct<s: bigint, k: int, e: bigint, v: string>>"


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """``s, k, e, v`` (start, kind, end, matched text) of the leftmost non-overlapping matches. The pieces
    between the matches give their places; sums run over blocks so that many matches stay cheap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, v: F.struct(F.char_length(gap).cast("long").alias("g"), F.char_length(v).cast("long").alias("n"), v.alias("v")))
    # of the pairs' array, by reference from inside one transform, so that it is computed once
    blocks = F.transform(F.array(pairs), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))))
    empty = F.struct(F.lit(0).cast("long").alias("p"), _none().alias("a"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["p"] + x["g"]
        one = F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["n"]).alias("e"), x["v"].alias("v"))
        return F.struct((s + x["n"]).alias("p"), F.concat(acc["a"], F.array(one)).alias("a"))

    summed = F.transform(F.flatten(blocks), lambda block: F.aggregate(block, empty, step))
    shift = lambda a, p: F.transform(a, lambda x: F.struct((x["s"] + p).alias("s"), x["k"].alias("k"), (x["e"] + p).alias("e"), x["v"].alias("v")))
    start = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(f"array<{_SPANS}>").alias("a"))
    whole = F.aggregate(summed, start, lambda acc, b: F.struct((acc["p"] + b["p"]).alias("p"), F.concat(acc["a"], F.array(shift(b["a"], acc["p"]))).alias("a")), lambda acc: F.flatten(acc["a"]))
    return F.when(text.rlike(pattern), whole).otherwise(_none())


def _tail(z: str) -> str:
    """Two-sided normal tail of a named field (a rational approximation of erfc, 1.5e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2D)))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"({poly} * exp(-{z} * {z} / 2))"


_ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789abcdefghijklmnopqrstuvwxyz",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _battery(candidates: str) -> str:
    """SQL of the candidates with ``r`` (p-value of randomness) and ``p`` (of ordinary text, by weight)."""
    alphabet = "CASE x.b " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ALPHABETS.items()) + " END"
    steps = [
        # encoding and characters
        """named_struct('s', x.s, 'e', x.e, 'v', translate(rtrim('=', x.v), '-_', '+/'), 'b',
            CASE WHEN x.v RLIKE '^[0-9A-Fa-f]+$' THEN 16 WHEN x.v RLIKE '^([A-Z2-7]+|[a-z2-7]+)=*$' THEN 32
                 WHEN x.v RLIKE '^([0-9A-Z]+|[0-9a-z]+)$' THEN 36 WHEN x.v RLIKE '^[0-9A-Za-z]+$' THEN 62 ELSE 64 END)""",
        f"""named_struct('s', x.s, 'e', x.e, 'b', x.b, 'n', char_length(x.v),
            'digits', char_length(regexp_replace(x.v, '[^0-9]', '')),
            'c', transform(split(CASE WHEN x.b = 32 THEN upper(x.v) WHEN x.b < 62 THEN lower(x.v) ELSE x.v END, ''), ch -> instr({alphabet}, ch) - 1))""",
        """named_struct('s', x.s, 'e', x.e, 'b', x.b, 'n', CAST(x.n AS DOUBLE), 'digits', x.digits / x.n, 'c', x.c,
            'mean', aggregate(x.c, 0D, (a, y) -> a + y) / x.n,
            'squares', aggregate(transform(array_distinct(x.c), d -> size(filter(x.c, y -> y = d))), 0D, (a, y) -> a + CAST(y AS DOUBLE) * y),
            'high', CAST(size(filter(x.c, y -> 2 * y >= x.b)) AS DOUBLE),
            'runs', 1 + aggregate(zip_with(slice(x.c, 2, x.n), slice(x.c, 1, x.n - 1), (y, w) -> if((2 * y >= x.b) <> (2 * w >= x.b), 1, 0)), 0, (a, y) -> a + y))""",
        """named_struct('s', x.s, 'e', x.e, 'n', x.n, 'digits', x.digits, 'squares', x.squares,
            'z1', greatest(0D, (x.squares * x.b / x.n - x.n - (x.b - 1)) / sqrt(2 * (x.b - 1) * (x.n - 1) / x.n)),
            'mu', 2 * x.high * (x.n - x.high) / x.n + 1, 'runs', x.runs,
            'z3', coalesce((aggregate(zip_with(slice(x.c, 2, CAST(x.n AS INT)), slice(x.c, 1, CAST(x.n AS INT) - 1), (y, w) -> (y - x.mean) * (w - x.mean)), 0D, (a, y) -> a + y)
                / nullif(aggregate(x.c, 0D, (a, y) -> a + (y - x.mean) * (y - x.mean)), 0D) + 1 / x.n) * sqrt(x.n), 99D))""",
        f"""named_struct('s', x.s, 'e', x.e, 'n', x.n, 'z1', x.z1, 'z3', x.z3,
            'z2', coalesce((x.runs - x.mu) / nullif(sqrt(greatest(0D, (x.mu - 1) * (x.mu - 2) / (x.n - 1))), 0D), 99D),
            'zt', ({TEXT_COINCIDENCE} - (x.squares - x.n) / (x.n * (x.n - 1))) / sqrt(2 * {TEXT_COINCIDENCE} * (1 - {TEXT_COINCIDENCE}) / (x.n * (x.n - 1))),
            'mix', if(x.digits <= {TEXT_DIGITS}, 1D, exp(-x.n * (x.digits * ln(x.digits / {TEXT_DIGITS})
                + if(x.digits < 1, (1 - x.digits) * ln((1 - x.digits) / (1 - {TEXT_DIGITS})), 0D)))))""",
        f"""named_struct('s', x.s, 'e', x.e, 'n', x.n,
            'r', 3 * least({_tail("x.z1")} / if(x.z1 > 0, 2, 1), {_tail("x.z2")}, {_tail("x.z3")}),
            'p', 2 * least(x.mix, if(x.zt > 0, {_tail("x.zt")} / 2, 1D)))""",
    ]
    sql = candidates
    for step in steps:
        sql = f"transform({sql}, x -> {step})"
    return sql


def _outside(candidate: Column) -> Column:
    """The parts of a candidate outside the spans of ``base`` that are long enough to be candidates."""
    s, e = candidate["s"], candidate["e"]
    part = lambda a, b: F.struct(a.alias("s"), F.lit(3).alias("k"), b.alias("e"), F.substring(candidate["v"], (a - s + 1).cast("int"), (b - a).cast("int")).alias("v"))
    step = lambda acc, x: F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] > acc["p"], F.concat(acc["a"], F.array(part(acc["p"], x["s"])))).otherwise(acc["a"]).alias("a"))
    last = lambda acc: F.when(e > acc["p"], F.concat(acc["a"], F.array(part(acc["p"], e)))).otherwise(acc["a"])
    cut = F.filter("base", lambda b: (s < b["e"]) & (b["s"] < e))
    return F.aggregate(cut, F.struct(s.alias("p"), _none().alias("a")), step, last)


def scan(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or ``columns``), ``base`` and ``added``: arrays of spans (start ``s``, kind ``k`` as an index
    of ``KINDS``, end ``e``, text ``v``) in order of start and kind."""
    columns = columns or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(spans(text, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 6)
    out = docs.select(*columns, text.alias("_text"), F.array_sort(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))).alias("base"))
    parts = F.flatten(F.transform(spans(F.col("_text"), CANDIDATE, 3), _outside))
    mixed = F.filter(parts, lambda x: x["v"].rlike(f"^{CANDIDATE}$") & x["v"].rlike("[0-9]|[a-z][A-Z]") & x["v"].rlike("[A-Za-z]"))
    out = out.withColumn("_c", mixed)
    out = out.withColumn("_t", F.when(F.size("_c") > 0, F.expr(_battery("_c"))).otherwise(F.array()))
    # weighted step-up: p over weight against rate * rank / candidates
    out = out.withColumn("_t", F.expr("transform(array(aggregate(_t, 0D, (a, x) -> a + x.n) / greatest(1, size(_t))), m -> transform(_t, x -> named_struct('s', x.s, 'e', x.e, 'r', x.r, 'q', x.p * m / x.n)))[0]"))
    out = out.withColumn("_cut", F.expr(f"array_max(transform(array_sort(transform(_t, x -> x.q)), (q, i) -> if(q <= {RATE} * (i + 1) / size(_t), {RATE} * (i + 1) / size(_t), -1D)))"))
    added = F.expr(f"transform(filter(_t, x -> x.q <= _cut AND x.r >= {REJECT}), x -> named_struct('s', x.s, 'k', 3, 'e', x.e, 'v', substring(_text, CAST(x.s + 1 AS INT), CAST(x.e - x.s AS INT))))")
    return out.select(*columns, "base", F.coalesce(added, _none()).alias("added"))


def _joined(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents (columns of ``documents``) with every span replaced by ``mark``; ``n_chars`` follows the new
    text. Overlapping spans are one. Texts without spans, null ones too, stay as they are."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = scan(docs, columns)
    # what stays: from the furthest end so far to the next start
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit("").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.when(x["s"] >= acc["p"], F.concat(F.substring(F.col("text"), (acc["p"] + 1).cast("int"), (x["s"] - acc["p"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.concat(acc["t"], kept).alias("t"))

    clean = F.aggregate(F.array_sort(F.concat("base", "added")), start, step, lambda acc: F.concat(acc["t"], F.substring(F.col("text"), (acc["p"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = found.withColumn("text", F.when(F.size("base") + F.size("added") > 0, clean).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.size("base") + F.size("added") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)
