"""Suffix-array dedup: sparse suffix arrays over content-selected positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm._repeats import remove_repeats


def _ranked(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The order of word lists, and how many words each shares with its neighbour before it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        for x, y in zip(parts[a], parts[b]):
            if x != y:
                break
            n += 1
        shared.append(n)
    return np.array(order), np.array(shared)


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for lists that share their first ``depth`` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def match_suffixes(texts: list[list[bytes]], anchors: list[int], windows: list[int], window: int) -> list[np.ndarray]:
    """The suffixes at the selected positions are sorted and neighbours compared, and so is what
    stands before them, read backwards; a window that reaches ``left`` words before its position and
    the rest after it occurs twice if another suffix shares both extensions."""
    rights = _ranked([t[a:] for t, a in zip(texts, anchors, strict=True)])
    lefts = _ranked([t[:a][::-1] for t, a in zip(texts, anchors, strict=True)])
    anchor, count = np.array(anchors), np.array(windows)
    flags = [np.zeros(n, np.uint8) for n in windows]
    for left in range(int((anchor - count + 1).min()), int(anchor.max()) + 1):
        has = np.flatnonzero((anchor >= left) & (anchor - left < count))
        same = _classes(*rights, window - left)[has] * (len(texts) + 1) + _classes(*lefts, left)[has]
        first = np.zeros(len(has), bool)
        first[np.unique(same, return_index=True)[1]] = True
        for i in has[~first]:
            flags[i][anchors[i] - left] = 1
    return flags


def suffix_array_dedup(docs: DataFrame, min_words: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rk, doc_id, n_words, n_removed, spans, kept_text.

    Removes every word of a passage of ``min_words`` words or more that also starts earlier (smaller
    id, or earlier in the document), so one copy of each stays.  Words are split at ASCII white space
    and compared unchanged.  Suffixes are kept only at positions selected by the least hash of k
    words in each ``min_words`` words, about one in 21; groups of them that share k words are sorted,
    neighbours compared, and matches extended both ways to whole windows.

    Null and blank texts have no words.  A null id counts as smaller than any other; rows that agree in
    id and text are one document and get one result each.  An empty table gives an empty result.
    Other columns are not read.
    """
    return remove_repeats(docs, min_words, k, match_suffixes, id_col, text_col)
