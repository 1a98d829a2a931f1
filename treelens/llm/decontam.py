"""Benchmark decontamination by the q-gram lemma.

If a passage of m characters occurs in a text with at most e edits, the
occurrence shares at least m + 1 - q * (e + 1) of the passage's q-grams, all
on diagonals (text position - passage position) that differ by at most e.
Diagonals are cut into overlapping bands (width 2 * (e + 1), step e + 1), the
shared q-grams of each band are counted, bands that meet the bound are kept,
and a banded semi-global alignment verifies them.

Long passages are looked for in parts too: whatever stretch of ``part_chars``
characters occurs with e edits holds one of the windows of part_chars + 1 -
step characters that begin every ``step`` of them, with at most e edits.  A
window's q-grams lie on the same diagonals as its passage's, so that windows
are counted within the passage's bands.  Short passages are looked up exactly.

Both sides are lower-cased, characters other than letters and digits become
one space.  The benchmark is read in blocks of bounded size, so that what is
broadcast never grows with it.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_number, id_text, ship

Q = 10
_SEPARATORS = re.compile(r"[\W_]+")
_U = np.uint64
OUTPUT = "doc_id string, item_id long, begin long, end long, edits long, item_chars long"


#: Bytes below 128 in lower case, those that are neither letters nor digits as spaces.
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.encode("ascii").translate(_PLAIN).decode("ascii").split())
    return _SEPARATORS.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit value of the Q-gram at each position: eight characters packed, the last two mixed in."""
    if len(chars) < Q:
        return np.empty(0, _U)
    two = (chars ^ (chars >> np.uint32(8)) * np.uint32(0x9D)).astype(_U) & _U(0xFF)
    two = (two[:-1] << _U(8)) | two[1:]
    four = (two[:-2] << _U(16)) | two[2:]
    eight = (four[:-4] << _U(32)) | four[4:]
    return eight[:-2] + two[8:] * _U(0x9E3779B97F4A7C15)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)


class Items:
    """A block of benchmark passages with its q-gram index."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0, part_chars: int = 160):
        short = [(i, own) for i, t in items if 0 < len(own := normalise(t)) < min_chars]
        items = [(i, t) for i, t in items if len(normalise(t)) >= max(1, min_chars)]
        #: words of the short passages -> their ids, by number of words
        self.short: dict[int, dict[str, list[int]]] = {}
        for i, own in short:
            self.short.setdefault(own.count(" ") + 1, {}).setdefault(own, []).append(i)
        self.ids = [i for i, _ in items]
        self.chars = [codes(normalise(t)) for _, t in items]
        self.budget = np.array([int(rate * len(c)) for c in self.chars], np.int64)
        self.bound = np.array([len(c) + 1 - Q * (e + 1) for c, e in zip(self.chars, self.budget, strict=True)], np.int64)
        self.part_budget = int(rate * part_chars)
        self.step = self.part_budget or 1
        self.window = part_chars + 1 - self.step
        self.part_bound = self.window + 1 - Q * (self.part_budget + 1)
        if min(self.bound.min(initial=1), self.part_bound) < 1:
            raise ValueError(f"at {rate} edits a character the q-gram lemma promises nothing for some passages; take a smaller rate or a larger min_chars")
        self.long = np.array([len(c) > part_chars for c in self.chars], bool)
        #: shared q-grams without which a text holds nothing
        self.least = min([*self.bound.tolist(), *([self.part_bound] if self.long.any() else [])], default=1)
        grams = [qgrams(c) for c in self.chars]
        if grams:
            gram = np.concatenate(grams)
            item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            at = np.concatenate([np.arange(len(g)) for g in grams])
        else:
            gram, item, at = np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], item[order], at[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[_slot(gram, self.BITS)] = True


#: Cells of the alignments that run side by side.
CELLS = 1 << 15
_NOTHING = np.uint32(0xFFFFFFFF)  # no character: fills regions up to one width


def align(item: np.ndarray, regions: list[np.ndarray], budget: int) -> list[tuple[int, int, int] | None]:
    """Of each region the least (edits, begin, end) of ``item`` in it, None where that takes more than ``budget`` edits.

    Semi-global edit distance of all regions side by side, one step per
    character of the item.  A cell holds edits * base + begin, less base for
    each character of the region before it, so that the chain of insertions
    along the region is a running minimum.
    """
    width = max(map(len, regions))
    text = np.full((len(regions), width), _NOTHING)
    for row, region in enumerate(regions):
        text[row, : len(region)] = region
    base = width + 1
    steps = np.arange(width + 1, dtype=np.int64)
    cell = np.broadcast_to(steps - steps * base, (len(regions), width + 1)).copy()
    rows = np.arange(len(regions))
    for k, c in enumerate(item, 1):
        change = cell[:, :-1] - (text == c) * base
        cell += base
        np.minimum(cell[:, 1:], change, out=cell[:, 1:])
        np.minimum.accumulate(cell, axis=1, out=cell)
        if k % 16 == 0:
            alive = (cell + steps * base).min(axis=1) < (budget + 1) * base
            if not alive.all():
                if not alive.any():
                    return [None] * len(regions)
                cell, text, rows = cell[alive], text[alive], rows[alive]
    found: list[tuple[int, int, int] | None] = [None] * len(regions)
    cell += steps * base
    for row, end in zip(range(len(rows)), cell.argmin(axis=1).tolist(), strict=True):
        edits, begin = divmod(int(cell[row, end]), base)
        if edits <= budget:
            found[rows[row]] = edits, begin, end
    return found


def occurrences(text: str, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(index of item, begin, end, edits, item length) of the best verified occurrence of each item."""
    chars = codes(text)
    grams = qgrams(chars)
    where = np.flatnonzero(items.seen[_slot(grams, items.BITS)])
    if not len(where):
        return []
    if len(where) < items.least:
        return []
    low = np.searchsorted(items.gram, grams[where], "left")
    found = np.searchsorted(items.gram, grams[where], "right") - low
    where, low, found = where[found > 0], low[found > 0], found[found > 0]
    if not len(where):
        return []
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
    item, text_at = items.item[entry], np.repeat(where, found)
    # whatever the band, a passage needs its bound of shared q-grams in all
    shared = np.bincount(item, minlength=len(items.bound))
    enough = shared >= items.bound
    best = _whole(chars, items, item[enough[item]], text_at[enough[item]], entry[enough[item]])
    parts = [i for i in np.flatnonzero(items.long & (shared >= items.part_bound)).tolist() if i not in best]
    if parts:
        order = np.argsort(item, kind="stable")
        ends = np.cumsum(shared)
        for i in parts:
            own = order[ends[i] - shared[i] : ends[i]]
            if hit := _part(chars, items, i, text_at[own], items.at[entry[own]]):
                best[i] = hit
    return [(i, b, e, edits, len(items.chars[i])) for i, (edits, b, e) in sorted(best.items())]


def _part(chars: np.ndarray, items: Items, i: int, text_at: np.ndarray, at: np.ndarray) -> tuple[int, int, int] | None:
    """The first verified window of a long passage: (edits, begin, end)."""
    budget, window, item = items.part_budget, items.window, items.chars[i]
    starts = np.unique(np.append(np.arange(0, len(item) - window, items.step), len(item) - window))
    cell = (text_at - at) // (budget + 1)
    order = np.argsort(cell, kind="stable")
    cell, at = cell[order], at[order]
    for band, first, last in _bands(cell, items.part_bound):
        own = np.unique(at[first:last])
        if len(own) < items.part_bound:
            continue
        inside = np.searchsorted(own, starts + window - Q, "right") - np.searchsorted(own, starts)
        lowest = band * (budget + 1)
        for start in starts[inside >= items.part_bound].tolist():
            begin, end = max(0, lowest + start - budget), min(len(chars), lowest + start + 2 * (budget + 1) + window + budget)
            hit = align(item[start : start + window], [chars[begin:end]], budget)[0]
            if hit:
                return hit[0], begin + hit[1], begin + hit[2]
    return None


def _bands(cell: np.ndarray, bound: int):
    """(band, first, last) of the bands whose cells have ``bound`` entries or more in the sorted ``cell``.

    Bands overlap: band b holds the diagonals of cells b and b + 1.
    """
    known = np.unique(cell)
    bands = np.union1d(known, known - 1)
    first, last = np.searchsorted(cell, bands), np.searchsorted(cell, bands + 1, "right")
    kept = last - first >= bound
    return zip(bands[kept].tolist(), first[kept].tolist(), last[kept].tolist(), strict=True)


def _whole(chars: np.ndarray, items: Items, item: np.ndarray, text_at: np.ndarray, entry: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Index of each passage found whole -> (edits, begin, end) of its best occurrence."""
    order = np.lexsort((text_at - items.at[entry], item))
    item, at, diagonal = item[order], items.at[entry[order]], (text_at - items.at[entry])[order]
    best: dict[int, tuple[int, int, int]] = {}
    for i in np.unique(item).tolist():
        low, high = np.searchsorted(item, i), np.searchsorted(item, i, "right")
        hit = _best(chars, items.chars[i], int(items.budget[i]), int(items.bound[i]), diagonal[low:high], at[low:high])
        if hit:
            best[i] = hit
    return best


def _best(chars: np.ndarray, passage: np.ndarray, budget: int, bound: int, diagonal: np.ndarray, at: np.ndarray) -> tuple[int, int, int] | None:
    """The least (edits, begin, end) in the bands that meet the bound, those that may hold the fewest edits first."""
    m, bands = len(passage), []
    for band, first, last in _bands(diagonal // (budget + 1), bound):
        # several text positions may hit one q-gram of the passage: count the different ones
        shared = len(np.unique(at[first:last]))
        if shared >= bound:
            lowest = band * (budget + 1)
            # e edits spoil at most Q * e of the passage's q-grams
            bands.append((-((shared - (m + 1 - Q)) // Q), max(0, lowest - budget), min(len(chars), lowest + 2 * (budget + 1) + m + budget)))
    bands.sort()
    best, done, size = None, 0, 1
    most = max(1, CELLS // (m + 4 * budget + 4))
    while done < len(bands):
        # what a band may hold at best gets worse from one to the next
        some = [(begin, end) for least, begin, end in bands[done : done + size] if best is None or (least, begin) < best[:2]]
        if not some:
            break
        for (begin, _), hit in zip(some, align(passage, [chars[b:e] for b, e in some], budget), strict=True):
            if hit and (best is None or (hit[0], begin + hit[1], begin + hit[2]) < best):
                best = hit[0], begin + hit[1], begin + hit[2]
        done, size = done + size, min(2 * size, most)
    return best


def exact(text: str, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(id, begin, end, 0, length) of the first occurrence of each short passage, on word boundaries."""
    if not items.short:
        return []
    words, found = text.split(" "), {}
    places = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    for n, known in items.short.items():
        for k in range(len(words) - n + 1):
            own = text[places[k] : places[k + n] - 1]
            for i in known.get(own, ()):
                found.setdefault((i, own), (i, places[k], places[k] + len(own), 0, len(own)))
    return list(found.values())


def _blocks(benchmark: DataFrame, max_chars: int):
    """Passages in blocks of at most ``max_chars`` characters (one longer passage fills a block)."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > max_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def _found(text: str | None, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(item's id, begin, end, edits, item length) of everything found in a text."""
    if not text or not (text := normalise(text)):
        return []
    return [(items.ids[i], *rest) for i, *rest in occurrences(text, items)] + exact(text, items)


def _search(shared):
    def run(batches):
        items = shared()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows += [(doc_id, *x) for x in _found(text, items)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return run


def _keep_clean(shared):
    def run(batches):
        items = shared()
        for batch in batches:
            yield batch.filter(pa.array([not _found(t, items) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def _searched(docs: DataFrame, benchmark: DataFrame, rate: float, min_chars: int, max_block_chars: int, part_chars: int):
    """The benchmark's blocks as functions that give them on executors."""
    passages = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for block in _blocks(passages, max_block_chars):
        items = Items(block, rate, min_chars, part_chars)
        if items.ids or items.short:
            yield ship(docs.sparkSession, items)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40, max_block_chars: int = 4_000_000, part_chars: int = 160) -> DataFrame:
    """Benchmark passages found in the documents: ``doc_id, item_id, begin, end, edits, item_chars``.

    A passage counts as found when the whole of it aligns with at most
    ``rate`` * its normalised length edits (an error where the lemma's bound
    would not be positive: from 1/10 on, and for short passages before that),
    or, of a passage longer than ``part_chars``, any stretch
    of so many characters with at most ``rate`` * part_chars edits (begin, end
    and edits are then those of the first window found).  Passages of fewer
    than ``min_chars`` normalised characters are found where they stand
    exactly, on word boundaries.  Positions count characters of the normalised text;
    of several occurrences of one passage in one row the best is reported.
    Null and empty texts contain nothing; null passages and those without a
    letter or digit are never looked for; documents
    with a null doc_id are reported with null; repeated rows each report;
    extra columns are ignored; empty tables give an empty table.
    """
    texts = docs.select(id_text("doc_id"), "text").where("text is not null")
    parts = [texts.mapInPandas(_search(shared), OUTPUT) for shared in _searched(docs, benchmark, rate, min_chars, max_block_chars, part_chars)]
    return id_number(reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], OUTPUT), "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40, max_block_chars: int = 4_000_000, part_chars: int = 160) -> DataFrame:
    """The documents in which ``contaminated`` finds no passage, all columns as they came.

    Each row is judged by its own text, in place and in one pass however many
    blocks the benchmark has: contaminated rows with a null doc_id go too, and
    clean rows that share the id of a contaminated one stay.
    """
    for shared in _searched(docs, benchmark, rate, min_chars, max_block_chars, part_chars):
        docs = docs.mapInArrow(_keep_clean(shared), docs.schema)
    return docs
