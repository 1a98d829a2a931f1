"""Removal of long byte strings that stand more than once, across all documents.

Suffix arrays are built over shards that Spark deals out so that equal strings
meet: a window of LENGTH bytes belongs to the shard of its anchor, the least
hash of its GRAM-byte pieces, which depends on the window's bytes alone.

1. Every task finds the runs of windows with the same anchor in its documents.
   Anchors that stand once in the whole table cannot be part of a repeat.
2. The runs of the other anchors are cut out of the texts, with all bytes of
   their windows.  Equal segments are put together, with partial aggregation,
   before they move; one that stands more than once goes to its shard twice.
3. Each shard is sorted by external induced sorting (see ``induced``), and
   windows whose common prefix with a neighbour is long enough are marked.
4. Marks go back to all places of their segment, and documents lose what they
   cover.

An anchor with very many runs (a common passage in many surroundings) is split
by a second anchor, the greatest hash of the window, so that one shard need not
hold all of them; a shard that is large nevertheless spills to disk.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from .common import save

#: Bytes of a string that must not stand twice, and of the pieces that anchors are chosen from.
LENGTH, GRAM = 400, 32
#: Starts of windows in one segment at most: longer runs are cut, which moves no window to another shard.
SEGMENT_STARTS = 1 << 15
#: Runs from which an anchor is split by the second anchor, and bytes of segments in a shard on average.
HOT_RUNS, SHARD_BYTES = 4096, 3 << 20
#: Between segments: a byte that UTF-8 has nowhere.
_END = 255

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


_known_powers: dict[int, np.ndarray] = {}


def _powers(n: int, factor: int) -> np.ndarray:
    """The first powers of a factor, kept up to those of the longest text (a process grows them by doubling)."""
    if factor not in _known_powers or len(_known_powers[factor]) < n:
        found = np.full(1 << max(16, (n - 1).bit_length()), factor, np.uint64)
        found[0] = 1
        _known_powers[factor] = np.multiply.accumulate(found)
    return _known_powers[factor][:n]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every piece of ``gram`` bytes (a polynomial, mixed)."""
    n = len(text)
    up, down = _powers(n, _FACTOR), _powers(n, _INVERSE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    x = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def sliding(x: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, in linear time."""
    pick = np.minimum if least else np.maximum
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, x[-1], x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    first = np.concatenate([[0], cut])
    return first, np.append(cut - 1, len(values) - 1)


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, times) of each run of windows with the same anchor.

    times: 2 if the anchor stands at two places of the run's windows, else 1.
    """
    hashes = gram_hashes(np.frombuffer(text, np.uint8), gram)
    least = sliding(hashes, length - gram + 1)
    first, last = _runs(least)
    anchor = least[first]
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    times = np.ones(len(anchor), np.int32)
    if len(again):
        # only pieces that the text has twice can be there twice
        again = np.intersect1d(again, anchor)
        chosen = np.flatnonzero(np.isin(hashes, again))
        wide = np.int64(len(hashes) + 1)
        keys = np.sort(np.searchsorted(again, hashes[chosen]) * wide + chosen)
        base = np.searchsorted(again, anchor) * wide
        here = np.searchsorted(keys, base + last + (length - gram), side="right") - np.searchsorted(keys, base + first)
        times[np.isin(anchor, again) & (here > 1)] = 2
    return anchor.view(np.int64), first, last, times


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text``: rows of equal id and text have the same key (and the same result)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text).cast("binary")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _find_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, anchor, first, last, n`` of every run: n is 2 if its anchor stands in it twice, else 1."""

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch["key"], batch["text"]):
                found.append(anchors(_encoded(text), length, gram))
                keys += [key] * len(found[-1][0])
            if found:
                anchor, first, last, n = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"key": keys, "anchor": anchor, "first": first, "last": last, "n": n})

    return rows.where(F.octet_length("text") >= length).select("key", "text").mapInPandas(run, "key binary, anchor long, first int, last int, n int")


def _segments(rows: DataFrame, length: int, gram: int, starts: int) -> DataFrame:
    """``segment, shard, content, key, first``: the windows of the runs in columns firsts, lasts, anchors and hot."""

    def cut(key, text: str, runs) -> list[tuple]:
        raw, found, greatest = _encoded(text), [], None
        for first, last, anchor, hot in runs:
            pieces = [(anchor, first, last)]
            if hot:
                if greatest is None:
                    greatest = sliding(gram_hashes(np.frombuffer(raw, np.uint8), gram), length - gram + 1, least=False)
                a, b = _runs(greatest[first : last + 1])
                pieces = [(anchor ^ int(greatest[first + x].view(np.int64)) * 3, first + int(x), first + int(y)) for x, y in zip(a, b)]
            for shard, a, b in pieces:
                for at in range(a, b + 1, starts):
                    content = raw[at : min(b, at + starts - 1) + length]
                    found.append((hashlib.blake2b(content, digest_size=16).digest(), (shard + (1 << 63)) % (1 << 64) - (1 << 63), content, key, at))
        return found

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for key, text, firsts, lasts, own, hot in zip(batch["key"], batch["text"], batch["firsts"], batch["lasts"], batch["anchors"], batch["hots"]):
                more = cut(key, text, zip(firsts.tolist(), lasts.tolist(), own.tolist(), hot.tolist()))
                found += more
                held += sum(len(x[2]) for x in more)
                if held > 8 << 20:
                    yield pd.DataFrame(found, columns=["segment", "shard", "content", "key", "first"])
                    found, held = [], 0
            yield pd.DataFrame(found, columns=["segment", "shard", "content", "key", "first"])

    return rows.mapInPandas(run, "segment binary, shard long, content binary, key binary, first int")


def _mark(shards: DataFrame, length: int, memory: int, in_memory: int) -> DataFrame:
    """``segment, low, high``: starts in a segment whose windows stand twice in the shards that are the partition, in order of shard and n.

    All windows of a segment that stands more than once are repeats, so it is
    sorted only for what others share with it, and once.
    """

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:  # spills of this task alone
            path, names, ends = f"{folder}/text", [], []
            with open(path, "wb") as f:
                at, before, alone = 0, None, False
                for batch in batches:
                    copies = []
                    for segment, shard, content, n in zip(batch["segment"], batch["shard"], batch["content"], batch["n"]):
                        if shard != before:
                            # those that stand once come first: without any, there is nothing else to find in this shard
                            before, alone = shard, n > 1
                        if n > 1:
                            copies.append((segment, 0, len(content) - length))
                        if alone:
                            continue
                        f.write(content)
                        f.write(bytes([_END]))
                        at += len(content) + 1
                        names.append(None if n > 1 else segment)
                        ends.append(at)
                    if copies:
                        yield pd.DataFrame(copies, columns=["segment", "low", "high"])
            if not ends:
                return
            text = np.memmap(path, np.uint8, "r") if at > memory // 8 else np.fromfile(path, np.uint8)
            marks = induced.repeats(text, length, induced.Scratch(folder, memory), in_memory)
            ends_, begins = np.array(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
            once = np.array([name is not None for name in names])
            lows, highs, owners = [], [], []
            for a in range(0, len(text), 1 << 22):
                at_ = np.flatnonzero(marks[a : a + (1 << 22)]) + a
                if not len(at_):
                    continue
                owner = np.searchsorted(ends_, at_, side="right")
                inside = (at_ + length < ends_[owner]) & once[owner]  # no window runs into the end mark
                at_, owner = at_[inside], owner[inside]
                if not len(at_):
                    continue
                new = np.append(True, (at_[1:] != at_[:-1] + 1) | (owner[1:] != owner[:-1]))
                first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(at_) - 1)
                lows.append(at_[first] - begins[owner[first]])
                highs.append(at_[last] - begins[owner[first]])
                owners.append(owner[first])
            if lows:
                owner = np.concatenate(owners)
                yield pd.DataFrame({"segment": [names[o] for o in owner], "low": np.concatenate(lows), "high": np.concatenate(highs)})

    return shards.mapInPandas(run, "segment binary, low int, high int")


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [a, b) joined where they touch or overlap."""
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS, starts: int = SEGMENT_STARTS, memory: int = induced.MEMORY, in_memory: int = induced.IN_MEMORY) -> DataFrame:
    """``key, lows, highs``: for each key of ``keyed(docs)`` with repeats, the starts (first and last) of windows that stand elsewhere too."""
    rows = keyed(docs)
    runs = save(_find_runs(rows, length, gram), "runs")
    counted = runs.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", (F.col("n") >= hot_runs).alias("hot"))
    wanted = runs.join(counted, "anchor").groupBy("key").agg(F.collect_set(F.struct("first", "last", "anchor", "hot")).alias("runs"))
    wanted = wanted.select("key", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"), F.col("runs.anchor").alias("anchors"), F.col("runs.hot").alias("hots"))
    segments = save(_segments(rows.select("key", "text").join(wanted, "key"), length, gram, starts), "segments")
    whole = segments.groupBy("segment", "shard").agg(F.first("content").alias("content"), F.count("*").alias("n"))
    size = segments.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = whole.repartition(max(1, -(-size // shard_bytes)), "shard").sortWithinPartitions("shard", "n")
    marks = save(_mark(shards, length, memory, in_memory), "marks")
    places = segments.select("segment", "key", "first").distinct()
    found = places.join(marks, "segment")
    return found.groupBy("key").agg(F.collect_set(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("s")).select("key", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))


def dedupe(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (binary, what is left) of every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in another row or in the same one (overlaps count); all
    strings are judged on the input.  Null texts are empty; rows of equal id and
    text are copies of each other and lose the same; ids may be null; extra
    columns are ignored; an empty table gives no rows.  What is left need not be
    UTF-8, as bytes go, not characters.
    """
    spans = repeated_spans(docs, length, **options)

    def run(batches):
        for batch in batches:
            found = []
            for doc_id, text, lows, highs in zip(batch["doc_id"], batch["text"], batch["lows"], batch["highs"]):
                raw = _encoded(text)
                gone = [] if lows is None else covered([(a, b + length) for a, b in zip(lows.tolist(), highs.tolist())])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                found.append((doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(found, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = keyed(docs).join(spans, "key", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lows", "highs")
    cut = rows.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))
