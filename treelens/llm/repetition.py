"""Quality rules with suffix-array repetition.

Method: a suffix array over a document's words (prefix doubling) and the
longest common prefixes of neighbouring suffixes.  Every maximal run of equal
prefixes is an LCP interval, that is a maximal repeated word sequence; the
spans of all repeats of at least ``min_words`` words are united.  A document
fails if too large a share of its words lies in repeats or if its longest
repeat is too long.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import id_number, id_text

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")

OUTPUT = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``codes`` and the LCP of each suffix with the one before it."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    ranked = codes[order]
    rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    levels, width = [rank.astype(np.int32)], 1  # levels[k] ranks the prefixes of 2**k words
    while width < n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        width *= 2
        levels.append(rank.astype(np.int32))
    # LCP by descending over the widths; a prefix that runs past the end equals no other.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = (a + step <= n) & (b + step <= n)
        same = np.zeros(len(a), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        lcp += step * same
        a += step * same
        b += step * same
    return order, np.concatenate([[0], lcp])


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence that starts there and occurs elsewhere too."""
    n = len(codes)
    out = np.zeros(n, np.int64)
    if n > 1:
        order, lcp = suffix_array(codes)
        out[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return out


def covered(repeats: np.ndarray, least: int) -> int:
    """Words in the union of the spans [i, i + repeats[i]) of at least ``least`` words."""
    n = len(repeats)
    starts = np.flatnonzero(repeats >= least)
    if not len(starts):
        return 0
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + repeats[starts], minlength=n + 1)
    return int(np.count_nonzero(np.cumsum(edge)[:n] > 0))


def covered_windows(repeats: np.ndarray, width: int) -> int:
    """Words in windows of exactly ``width`` words that occur at least twice."""
    return covered(np.where(repeats >= width, width, 0), width)


def judge(text: str | None, min_words: int, max_percent: int, max_longest_percent: int, longest_from: int) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = longest_repeats(codes)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    n_repeat = covered_windows(repeats, 3)
    base_failed = n < 50 or 100 * n_repeat > 50 * n
    inside, longest = covered(repeats, min_words), int(repeats.max()) if n else 0
    repetitive = 100 * inside > max_percent * n or (longest >= longest_from and 100 * longest > max_longest_percent * n)
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), n_repeat, base_failed, not (base_failed or repetitive), inside, longest


def quality_rules(docs: DataFrame, min_words: int = 8, max_percent: int = 30, max_longest_percent: int = 10, longest_from: int = 50) -> DataFrame:
    """Counts and verdict of every document's whole text.

    ``max_percent``: of the words, as many at most may lie in repeats of at
    least ``min_words`` words (the base rule alone lets half of them).
    ``max_longest_percent``: as many at most in the longest repeat, if that
    has ``longest_from`` words or more (two copies of it may stay below the first limit).
    Null text counts as empty (all counts 0, base_failed true); repeated rows
    each get a row; null doc_id stays null; extra columns are ignored; an
    empty table gives an empty table.
    """

    def run(batches):
        names = [x.split()[0] for x in OUTPUT.split(", ")][1:]
        for batch in batches:
            rows = [judge(t, min_words, max_percent, max_longest_percent, longest_from) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return id_number(docs.select(id_text("doc_id"), "text").mapInPandas(run, OUTPUT), "doc_id")
