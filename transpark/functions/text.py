"""Column expressions for sentence text.

Everything here is a built-in Spark expression (JVM side, no Python per row).
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as
# whitespace, as a regex class that Java and RE2 read the same way.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_RUN = WS + "+"
# The same characters but the blank, one by one.
_OTHER_WS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Fixed value: the subword boundary marker of sentencepiece.
PIECE_MARK = "▁"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col) -> Column:
    """``str.split()``: split on runs of Unicode whitespace, no empty tokens. All whitespace is made blanks first: Java
    cuts at one plain character without trying a pattern at every place."""
    return F.array_remove(F.split(F.translate(_c(col), _OTHER_WS, " " * len(_OTHER_WS)), " "), "")


def word_counter(col) -> Column:
    """The number of every distinct word, as ``map<word, count>`` in order of words: the sorted words, cut
    where a new word begins. Null text has no map."""
    ordered = F.sort_array(words(col))

    def counted(s: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return bound(F.filter(every, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), lambda starts: runs(s, starts))

    def runs(s: Column, starts: Column) -> Column:
        ends = F.slice(F.concat(starts, F.array(F.size(s))), F.lit(2), F.size(starts))
        numbers = F.zip_with(starts, ends, lambda a, b: (b - a).cast("long"))
        return F.map_from_arrays(F.transform(starts, lambda i: F.get(s, i)), numbers)

    # by way of an array of one element, so that the sorted words and the starts are made once for a text: a lambda
    # makes an expression that it refers to anew for every element
    def bound(value: Column, fn) -> Column:
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    return F.when(_c(col).isNotNull(), bound(ordered, counted))


def ttr(col) -> Column:
    """Type-token ratio, case-sensitive; NULL for a blank line (the reference divides by zero there)."""
    w = words(col)
    return F.try_divide(F.size(F.array_distinct(w)), F.size(w))


def strip(col) -> Column:
    """``str.strip()`` with the Unicode whitespace set."""
    return F.regexp_replace(_c(col), f"^{WS_RUN}|{WS_RUN}$", "")


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"{WS_RUN}$", "")


def squeeze(col) -> Column:
    """Words joined by one blank (what ``' '.join(s.split())`` gives)."""
    return F.array_join(words(col), " ")


def join_pieces(col) -> Column:
    """Sentencepiece pieces back to words: drop blanks, marker -> blank, strip."""
    return F.trim(F.replace(F.replace(_c(col), F.lit(" "), F.lit("")), F.lit(PIECE_MARK), F.lit(" ")))


def fixed_pieces(col, width: int = 3) -> Column:
    """Stand-in subword encoder: every word gets the boundary marker and is cut
    into pieces of ``width`` characters (a real encoder plugs in instead)."""
    return F.array_join(
        F.transform(
            words(col),
            lambda w: F.trim(F.regexp_replace(F.concat(F.lit(PIECE_MARK), w), "(.{%d})" % width, "$1 ")),
        ),
        " ",
    )


def split_lines(col) -> Column:
    """Lines the way Spark's text source cuts them (\\n, \\r\\n, \\r)."""
    return F.split(_c(col), r"\r\n|\r|\n")


# --- HTML unescape -----------------------------------------------------------
# Same result as Python's ``html.unescape``. Its tables (HTML5 names, the
# remapped numeric references, the dropped code points) are read from
# Python's standard library at import, not restated here.

_HTML5 = dict(html.entities.html5)
_LEGACY = {k: v for k, v in _HTML5.items() if not k.endswith(";")}  # names valid without ';'
_LEGACY_MAX = max(len(k) for k in _LEGACY)
_REMAPPED = dict(html._invalid_charrefs)  # type: ignore[attr-defined]
_DROPPED = sorted(html._invalid_codepoints)  # type: ignore[attr-defined]
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _str_map(d: dict) -> Column:
    keys = sorted(d)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(d[k]) for k in keys]))


def _by_first(d: dict) -> Column:
    """A map of maps, by first character: a lookup scans the names that begin alike, not all of them."""
    firsts = sorted({k[0] for k in d})
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in firsts]), F.array(*[_str_map({k: v for k, v in d.items() if k[0] == c}) for c in firsts])
    )


def _int_map(d: dict) -> Column:
    keys = sorted(d)
    return F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in keys]), F.array(*[F.lit(d[k]) for k in keys]))


def _numeric_char(digits: Column, base: int) -> Column:
    """A numeric reference body (digits only) -> its text, as html.unescape maps it."""
    d = F.regexp_replace(digits, "^0+", "")
    too_big = F.length(d) > F.lit(8 if base == 16 else 8)
    num = (F.conv(d, 16, 10) if base == 16 else d).try_cast("long")
    num = F.when(d == "", F.lit(0).cast("long")).otherwise(num)
    out_of_range = too_big | (num > 0x10FFFF) | ((num >= 0xD800) & (num <= 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")
    return (
        F.when(~too_big & F.map_contains_key(_int_map(_REMAPPED), num), F.element_at(_int_map(_REMAPPED), num))
        .when(out_of_range, F.lit("\ufffd"))
        .when(num.isin(*_DROPPED), F.lit(""))
        .otherwise(char)
    )


def _named(body: Column) -> Column:
    """A named reference body (with its ';' if any) -> text; longest legacy prefix otherwise."""
    first = F.substring(body, 1, 1)
    full = F.element_at(F.element_at(_by_first(_HTML5), first), body)
    common = F.when(body == "amp;", "&").when(body == "lt;", "<").when(body == "gt;", ">").when(body == "quot;", '"')
    legacy = F.element_at(_by_first(_LEGACY), first)
    prefixes = [
        F.when(
            F.length(body) - 1 >= x,
            F.concat(F.element_at(legacy, F.substring(body, 1, x)), F.substring(body, F.lit(x + 1), F.length(body))),
        )
        for x in range(_LEGACY_MAX, 1, -1)
    ]
    return F.coalesce(common, full, *prefixes, F.concat(F.lit("&"), body))


def unescape(col) -> Column:
    """HTML character references -> characters (``html.unescape``), one left-to-right pass.

    Pieces between references come from ``split``; the references themselves
    from ``regexp_extract_all``; both are zipped back together.
    """
    c = _c(col)
    pieces = F.split(c, ENTITY, -1)
    refs = F.regexp_extract_all(c, F.lit(ENTITY), 1)

    def decode_ref(body: Column) -> Column:
        digits = F.regexp_replace(body, ";$", "")
        is_hex = F.lower(F.substring(body, 1, 2)) == "#x"
        is_dec = (F.substring(body, 1, 1) == "#") & ~is_hex
        return (
            F.when(is_hex, _numeric_char(F.substring(digits, F.lit(3), F.length(digits)), 16))
            .when(is_dec, _numeric_char(F.substring(digits, F.lit(2), F.length(digits)), 10))
            .otherwise(_named(body))
        )

    decoded = F.transform(refs, decode_ref)
    glued = F.zip_with(pieces, F.concat(decoded, F.array(F.lit(""))), lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
    return F.when(F.instr(c, "&") > 0, F.array_join(glued, "")).otherwise(c)
