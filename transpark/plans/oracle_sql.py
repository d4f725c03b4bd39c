"""SQL text pieces for the independent DuckDB check of every registered query.

These build plain ANSI/DuckDB SQL strings; they share only fixed values
(the whitespace class, the 13a rules) with the Spark side, not code paths.
"""

from __future__ import annotations

from transpark.functions.bleu13a import RULES_13A, UNESCAPE_13A
from transpark.functions.text import WS


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def ttr_of(w: str) -> str:
    return f"CASE WHEN len({w}) = 0 THEN NULL ELSE len(list_distinct({w})) / len({w}) END"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tok13a(x: str) -> str:
    s = f"regexp_replace({x}, '{WS}+$', '')"
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for a, b in UNESCAPE_13A:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    for pattern, repl in RULES_13A:
        s = f"regexp_replace({s}, '{pattern}', '{repl.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return words(s)


def grams(tok: str, n: int) -> str:
    return f"[array_to_string({tok}[i:i+{n - 1}], ' ') for i in range(1, len({tok}) - {n - 2})]"


def segment_stats(pairs_sql: str, keys: list[str]) -> str:
    """CTE list (without WITH) ending in ``seg(keys..., sys_len, ref_len, m1..m4, t1..t4)``."""
    k = ", ".join(keys)
    g_h = " UNION ALL ".join(
        f"SELECT {k}, {n} AS n, 1 AS h, 0 AS r, unnest({grams('th', n)}) AS g FROM tok" for n in range(1, 5)
    )
    g_r = " UNION ALL ".join(
        f"SELECT {k}, {n} AS n, 0 AS h, 1 AS r, unnest({grams('tr', n)}) AS g FROM tok" for n in range(1, 5)
    )
    ms = ", ".join(f"sum(CASE WHEN n = {n} THEN least(ch, cr) ELSE 0 END)::BIGINT AS m{n}" for n in range(1, 5))
    ts = ", ".join(f"greatest(len(th) - {n - 1}, 0)::BIGINT AS t{n}" for n in range(1, 5))
    mc = ", ".join(f"coalesce(mm.m{n}, 0)::BIGINT AS m{n}" for n in range(1, 5))
    return f"""
pairs AS ({pairs_sql}),
tok AS (SELECT {k}, {tok13a('hyp')} AS th, {tok13a('ref')} AS tr FROM pairs),
g AS ({g_h} UNION ALL {g_r}),
gc AS (SELECT {k}, n, g, sum(h) AS ch, sum(r) AS cr FROM g GROUP BY ALL),
mm AS (SELECT {k}, {ms} FROM gc GROUP BY ALL),
seg AS (SELECT {', '.join('tok.' + c for c in keys)}, len(th)::BIGINT AS sys_len, len(tr)::BIGINT AS ref_len, {mc}, {ts}
        FROM tok LEFT JOIN mm USING ({k}))"""


STATS = ["sys_len", "ref_len", "m1", "m2", "m3", "m4", "t1", "t2", "t3", "t4"]


def sums() -> str:
    return ", ".join(f"sum({c})::BIGINT AS {c}" for c in STATS)


def bleu_cols() -> str:
    """bleu, bp, p1..p4 (rounded to 6 places) from summed statistics in scope."""
    bp = "CASE WHEN sys_len >= ref_len THEN 1.0::DOUBLE WHEN sys_len > 0 THEN exp(1.0::DOUBLE - ref_len / sys_len) ELSE 0.0::DOUBLE END"
    no_match = "(m1 = 0 AND m2 = 0 AND m3 = 0 AND m4 = 0)"
    ps = []
    for n in range(1, 5):
        blocked = " OR ".join(f"t{i} = 0" for i in range(1, n + 1))
        zeros = " + ".join(f"(CASE WHEN m{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, n + 1))
        ps.append(
            f"(CASE WHEN {no_match} OR {blocked} THEN 0.0::DOUBLE "
            f"WHEN m{n} = 0 THEN 100.0::DOUBLE / (pow(2.0::DOUBLE, {zeros}) * t{n}) "
            f"ELSE 100.0::DOUBLE * m{n} / t{n} END)"
        )
    logsum = " + ".join(f"ln({p})" for p in ps)
    score = f"(CASE WHEN {no_match} OR t1 = 0 OR t2 = 0 OR t3 = 0 OR t4 = 0 THEN 0.0::DOUBLE ELSE ({bp}) * exp(({logsum}) / 4.0::DOUBLE) END)"
    cols = [f"{r6(score)} AS bleu", f"{r6(bp)} AS bp"] + [f"{r6(p)} AS p{i + 1}" for i, p in enumerate(ps)]
    return ", ".join(cols)


def bleu_raw() -> str:
    """Unrounded BLEU score expression (for averaging over batches)."""
    bp = "CASE WHEN sys_len >= ref_len THEN 1.0::DOUBLE WHEN sys_len > 0 THEN exp(1.0::DOUBLE - ref_len / sys_len) ELSE 0.0::DOUBLE END"
    no_match = "(m1 = 0 AND m2 = 0 AND m3 = 0 AND m4 = 0)"
    ps = []
    for n in range(1, 5):
        zeros = " + ".join(f"(CASE WHEN m{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, n + 1))
        ps.append(f"(CASE WHEN m{n} = 0 THEN 100.0::DOUBLE / (pow(2.0::DOUBLE, {zeros}) * t{n}) ELSE 100.0::DOUBLE * m{n} / t{n} END)")
    logsum = " + ".join(f"ln({p})" for p in ps)
    return f"(CASE WHEN {no_match} OR t1 = 0 OR t2 = 0 OR t3 = 0 OR t4 = 0 THEN 0.0::DOUBLE ELSE ({bp}) * exp(({logsum}) / 4.0::DOUBLE) END)"
