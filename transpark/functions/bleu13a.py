"""The '13a' BLEU tokenisation (mteval-v13a) as built-in expressions.

Public definition (Post 2018): right-strip, drop ``<skipped>``, join ``-\\n``,
newline -> blank, unescape four references, pad with blanks, then four regex
rules, then split on whitespace.

The first rule sets every symbol apart. The other three concern periods, commas
and hyphens; none of their matches reaches over white space, so they are applied
to the words that hold such a character, padded with blanks, and not to the text.

``tokenize_13a`` is the column; ``text_words`` and ``word_tokens`` are the same rules for tasks that cut
many texts: no match reaches over white space, so a word is cut once, however often it occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from transpark.functions.text import WS, _c, rstrip, words

# The 13a rules, in order (pattern, replacement).
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# The symbols of the first rule but for the blank, which words never hold.
SYMBOL = r"[\{-\~\[-\`\!-\&\(-\+\:-\@\/]"
# References undone before the rules, in this order.
UNESCAPE_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _cut(word: Column) -> Column:
    """The tokens of a word without symbols."""
    s = F.concat(F.lit(" "), word, F.lit(" "))
    for pattern, repl in RULES_13A[1:]:
        s = F.regexp_replace(s, pattern, repl)
    touched = F.contains(word, F.lit(".")) | F.contains(word, F.lit(",")) | F.contains(word, F.lit("-"))
    return F.when(touched, F.split(F.trim(s), " +")).otherwise(F.array(word))


def tokenize_13a(col) -> Column:
    """Tokens of one segment, as an array of strings."""
    s = _c(col)
    s = F.when(F.right(s, F.lit(1)).rlike(WS), rstrip(s)).otherwise(s)
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for a, b in UNESCAPE_13A:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, SYMBOL, " $0 ")
    return F.flatten(F.transform(words(s), _cut))


_SYMBOL = re.compile(SYMBOL)
_RULES = [(re.compile(pattern), repl.replace("$", "\\")) for pattern, repl in RULES_13A[1:]]


def text_words(text: str) -> list[str]:
    """The words of a segment, in which the tokens lie."""
    s = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in UNESCAPE_13A:
        s = s.replace(a, b)
    return s.split()


def word_tokens(word: str) -> list[str]:
    """The tokens of one of ``text_words``."""
    out: list[str] = []
    for part in _SYMBOL.sub(r" \g<0> ", word).split():
        if "." in part or "," in part or "-" in part:
            part = f" {part} "
            for pattern, repl in _RULES:
                part = pattern.sub(repl, part)
        out.extend(part.split())
    return out
