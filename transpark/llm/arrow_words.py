"""Words of a column of texts by Arrow kernels: letters, digits and everything beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Everything ASCII but digits and (after lower-casing) letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, and for every word in text order its code among them and its row.
    Null and empty texts have no words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(column), pattern=SEPARATORS)
    rows = pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    coded = pc.list_flatten(parts).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()  # before a first and after a last separator
    if empty >= 0:
        there = codes != empty
        codes, rows = codes[there], rows[there]
    return coded.dictionary, codes, rows
