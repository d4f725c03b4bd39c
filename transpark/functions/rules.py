"""Rule tables for punctuation normalisation, tokenisation and detokenisation
(P8-P10). Each table is an ordered list of (pattern, replacement) applied with
``regexp_replace``; patterns avoid look-around and back-references so that
Java's engine and RE2 read them the same way.

These are a compact re-statement of the usual statistical-MT preprocessing
(normalise punctuation, split punctuation off words, aggressive hyphen split
as ``@-@``, XML-escape), not a port of any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transpark.functions.text import WS_RUN, _c

# Rules of this package: punctuation normalisation, in order, but for the order of quotes and punctuation.
NORMALIZE = [
    (r"\r", ""),
    (r"[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}]", ""),  # control characters
    (r"[„“”«»]", '"'),
    (r"[‘’‚´`]", "'"),
    (r"–", "-"),
    (r"—", " - "),
    (r"…", "..."),
    (WS_RUN, " "),
    (r"^ | $", ""),
]

# Rules of this package: English puts commas and periods before a closing quote, other languages after it
# (periods only where a text goes on, since those at its end belong to the sentence).
QUOTE_ORDER = {
    "en": [(r"\"([,.]+)", "$1\"")],
    "other": [(r",\"", "\","), (r"([.]+)\"( *[^< ])", "\"$1$2")],
}


def normalize_rules(lang: str | None = "en"):
    """The rules for a language; None leaves quotes and punctuation in their order."""
    return NORMALIZE if lang is None else [*NORMALIZE, *QUOTE_ORDER.get(lang, QUOTE_ORDER["other"])]


# Abbreviations whose period never ends a sentence, and those whose period does not before
# a number (``No. 5``), by language. Single letters count as well (see below).
ABBREVIATIONS = {
    "en": (
        "Adm Asst Bldg Brig Capt Cmdr Col Cpl Dr Ens Gen Gov Hon Hosp Insp Lt Maj Messrs Mr Mrs Ms Mt Op Ph Pres Prof Pvt "
        "Rep Rev Rt Sen Sgt Sr St Supt e.g i.e v vs",
        "Art Fig No Nr Sec Vol fig p pp",
    ),
    "de": (
        "Abb Abk Abs Abt Anm Apr Art Aufl Aug Bd Best Bsp Ca Dez Dipl Dr Feb Fr Hr Hrn Ing Inh Jan Jh Jhdt Kap Mag Mio Mrd Nov "
        "Okt Prof Sept St Str Tel Verf Vgl abzgl allg bspw bzgl bzw ca dgl entspr etc evtl exkl geb gem ggf ggfs inkl insb jew "
        "max min mind mtl od oä sog tel u.a usw uvm vgl zB zzgl",
        "Nr S Seite",
    ),
}
#: Ordinal numbers are written with a period in German.
ORDINAL = {"de": r"[1-9][0-9]?"}
LETTER = {"en": r"\p{Lu}", "de": r"[\p{Lu}\p{Ll}]", "other": r"\p{Lu}"}
#: Stands for a period that belongs to its word while the others are split off (a private-use character).
KEPT = "\ue000"


def _any(words: str) -> str:
    return "|".join(w.replace(".", r"\.") for w in words.split())


def period_rules(lang: str):
    """The rules that split a word's last period off. First the periods that stay are marked: of abbreviations,
    of single letters, of words that hold a letter and another period (acronyms, addresses), and those before
    a word in lower case. A mark inside a word does no harm."""
    always, numeric = ABBREVIATIONS.get(lang, ("", ""))
    stay = "|".join(filter(None, [_any(always), ORDINAL.get(lang, ""), LETTER.get(lang, LETTER["other"])]))
    return [
        (rf"(^|[^\p{{L}}\p{{Nd}}.,\-])({stay})\.", f"$1$2{KEPT}"),
        *([(rf"(^|[^\p{{L}}\p{{Nd}}.,\-])({_any(numeric)})\.( ?[\p{{Nd}}])", f"$1$2{KEPT}$3")] if numeric else []),
        (rf"([^ ]*\p{{L}}[^ ]*[.{KEPT}][^ ]*)\.", f"$1{KEPT}"),
        (rf"([^ ]*[.{KEPT}][^ ]*\p{{L}}[^ ]*)\.", f"$1{KEPT}"),
        (r"([^ .])\.( \p{Ll})", f"$1{KEPT}$2"),  # twice: words of one letter overlap
        (r"([^ .])\.( \p{Ll})", f"$1{KEPT}$2"),
        (r"([^ .])\.( |$)", "$1 .$2"),
        (KEPT, "."),
    ]


# Rules of this package: tokenisation, in order (before escaping). ``{APOS}`` and
# ``{PERIOD}`` are replaced by the rules of the language.
TOKENIZE = [
    (WS_RUN, " "),
    (r"^ | $", ""),
    (r"([^\p{L}\p{Nd}\s\.'\,\-])", " $1 "),  # split off every other symbol
    (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", "$1 @-@ $2"),  # aggressive hyphen split (twice: runs overlap)
    (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", "$1 @-@ $2"),
    (r"([^\p{Nd}]),", "$1 , "),
    (r",([^\p{Nd}])", " , $1"),
    ("{APOS}", ""),
    (r"(\.\.+)", " $1 "),
    (WS_RUN, " "),
    (r"^ | $", ""),
    ("{PERIOD}", ""),
]

# Rules of this package: apostrophe rules for English (in order); other languages split every apostrophe off.
APOSTROPHE = {
    "en": [
        (r"([^\p{L}])'([^\p{L}])", "$1 ' $2"),
        (r"([^\p{L}\p{Nd}])'([\p{L}])", "$1 ' $2"),
        (r"([\p{L}])'([^\p{L}])", "$1 ' $2"),
        (r"([\p{L}])'([\p{L}])", "$1 '$2"),
        (r"([\p{Nd}])'(s)", "$1 '$2"),
    ],
    "other": [(r"'", " ' ")],
}


def tokenize_rules(lang: str = "en", dash_split: bool = True):
    out = []
    for pattern, repl in TOKENIZE:
        if pattern == "{APOS}":
            out.extend(APOSTROPHE.get(lang, APOSTROPHE["other"]))
        elif pattern == "{PERIOD}":
            out.extend(period_rules(lang))
        elif dash_split or "@-@" not in repl:
            out.append((pattern, repl))
    return out


# XML escaping after tokenisation ('&' first).
ESCAPE = [("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")]

#: Stands for a single quote on its own (a private-use character).
QUOTE = "\ue001"
# Rules of this package: detokenisation, in order (after un-escaping and before quoted spans).
DETOKENIZE = [
    (r" @-@ ", "-"),
    (r"% ([\p{Nd}])", "%$1"),  # placeholders like %1
    (r"([\p{Nd}]) %", "$1%"),
    (r" \( \)", "()"),
    (r"([\p{L}\p{Nd}]) \+ \+", "$1++"),
    (r" ([/_@+\\]) ", "$1"),  # paths, names, addresses and keys are written in one
    (r"(//|^/) ([\p{L}])", "$1$2"),
    (r"(^|[^\p{Nd} ] )([%~]) ([\p{L}])", "$1$2$3"),
    (r" ([\.\,\!\?\:\;\)\]\}])", "$1"),
    (r"([\(\[\{\$]) ", "$1"),
    (r" '([\p{L}])", "'$1"),
    (r"(^| )'( |$)", f"$1{QUOTE}$2"),  # an apostrophe on its own is a quote (twice: blanks overlap)
    (r"(^| )'( |$)", f"$1{QUOTE}$2"),
    (WS_RUN, " "),
    (r"^ | $", ""),
]
#: Marks of detokenisation and what they become: quotes, of which every other one opens a span.
QUOTES = [('"', '"'), (QUOTE, "'")]


def quoted(col) -> Column:
    """Text whose quoted spans hug their quotes: a quote opens a span if the last one before it closed one, so
    the spans are every other piece between quotes. A span that is never closed hugs its opening quote."""
    c = _c(col)
    for mark, quote in QUOTES:
        c = F.array_join(F.transform(F.split(c, mark), lambda piece, i: F.when(i % 2 == 1, F.trim(piece)).otherwise(piece)), quote)
    return c


def _near(mark: str, before: str, after: str = "") -> str:
    """``(before)mark(after)`` looked for from its mark, which is rare, and not from every character. What comes
    before is only looked at, and as it may not lie in the match before, a mark right after that is passed over.
    (Java looks back by code points, not by halves of them, only if the pattern holds a character beyond 16 bits;
    a letter and a digit of that kind stand in the classes below, to which they belong anyway.)"""
    return rf"{mark}(?<!\G{mark})(?<={before}{mark}){after}"


_ALNUM = r"[\p{L}\p{Nd}]"
#: Rules in a form that Java's engine reads in one pass over a text, with the same results: the plain form of
#: some tries all ways to divide a word, from every place in it. (RE2, which reads the plain form, has no look-around.)
FAST = {
    # runs of white space, but for the single blanks before ASCII, which stay as they are
    (WS_RUN, " "): (rf"(?=[^!-~])(?! [!-~]){WS_RUN}", " "),
    # the last period of a word, if a letter and then another period come before it, or a period and then a letter
    (rf"([^ ]*\p{{L}}[^ ]*[.{KEPT}][^ ]*)\.", f"$1{KEPT}"): (rf"(?<![^ ])([^ \p{{L}}]*+\p{{L}}[^ .{KEPT}]*+[.{KEPT}][^ ]*)\.", f"$1{KEPT}"),
    (rf"([^ ]*[.{KEPT}][^ ]*\p{{L}}[^ ]*)\.", f"$1{KEPT}"): (rf"(?<![^ ])([^ .{KEPT}]*+[.{KEPT}][^ \p{{L}}]*+\p{{L}}[^ ]*)\.", f"$1{KEPT}"),
    (r"([^ .])\.( \p{Ll})", f"$1{KEPT}$2"): (r"\.(?<=[^ .]\.)(?= \p{Ll})", KEPT),
    (r"([^ .])\.( |$)", "$1 .$2"): (r"\.(?<=[^ .]\.)(?= |$)", " ."),
    (rf"({_ALNUM})-({_ALNUM})", "$1 @-@ $2"): (r"-(?<=[\p{L}\p{Nd}𐀀]-)" + rf"(?={_ALNUM})", " @-@ "),
    (r"([^\p{Nd}]),", "$1 , "): (_near(",", r"[^\p{Nd}𝟘]"), " , "),
    (r"([^\p{L}])'([^\p{L}])", "$1 ' $2"): (_near("'", r"[^\p{L}𐀀]", r"([^\p{L}])"), " ' $1"),
    (r"([^\p{L}\p{Nd}])'([\p{L}])", "$1 ' $2"): (_near("'", r"[^\p{L}\p{Nd}𐀀]", r"([\p{L}])"), " ' $1"),
    (r"([\p{L}])'([^\p{L}])", "$1 ' $2"): (_near("'", r"[\p{L}𐀀]", r"([^\p{L}])"), " ' $1"),
    (r"([\p{L}])'([\p{L}])", "$1 '$2"): (_near("'", r"[\p{L}𐀀]", r"([\p{L}])"), " '$1"),
    (r"([\p{Nd}])'(s)", "$1 '$2"): (_near("'", r"[\p{Nd}𝟘]", "(s)"), " '$1"),
}
#: Rules that come twice because their matches overlap: their fast forms only look around, so once does.
ONCE = {(rf"({_ALNUM})-({_ALNUM})", "$1 @-@ $2"), (r"([^ .])\.( \p{Ll})", f"$1{KEPT}$2")}
_WORDS_HEAD = r"(^|[^\p{L}\p{Nd}.,\-])("


def fast(rule: tuple[str, str]) -> tuple[str, str]:
    """A rule in its fast form."""
    pattern, repl = rule
    if pattern.startswith(_WORDS_HEAD):  # a list of words before a period: first whether a period is near
        longest = max(map(len, pattern[len(_WORDS_HEAD) :].split(r")\.")[0].split("|")))
        return pattern.replace(_WORDS_HEAD, _WORDS_HEAD[:-1] + rf"(?=[^ .]{{1,{longest}}}+\.)(", 1), repl
    return FAST.get(rule, rule)


def apply_rules(col, rules) -> Column:
    c, last = _c(col), None
    for rule in map(tuple, rules):
        if rule == last and rule in ONCE:
            continue
        pattern, repl = fast(rule)
        if rule == (r"^ | $", "") and last == (WS_RUN, " "):
            c = F.trim(c)  # one blank at most is left at an end
        elif rule == (KEPT, "."):
            c = F.replace(c, F.lit(KEPT), F.lit("."))
        else:
            c = F.regexp_replace(c, pattern, repl)
        last = rule
    return c


def escape(col) -> Column:
    c = _c(col)
    for a, b in ESCAPE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_basic(col) -> Column:
    c = _c(col)
    for a, b in reversed(ESCAPE):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def normalize(col, lang: str | None = "en") -> Column:
    return apply_rules(col, normalize_rules(lang))


def tokenize(col, dash_split: bool = True, xml_escape: bool = True, lang: str = "en") -> Column:
    c = apply_rules(col, tokenize_rules(lang, dash_split))
    return escape(c) if xml_escape else c


def detokenize(col) -> Column:
    return quoted(apply_rules(unescape_basic(col), DETOKENIZE))
