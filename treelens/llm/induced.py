"""External induced sorting of suffixes with their common prefixes.

``repeats`` tells for every position of a text whether the ``depth`` symbols
from there stand at another position too.  Suffixes are sorted as induced
sorting does:

1. Positions are of type S (smaller than the next suffix) or L.  Substrings
   from one leftmost S position (a seed) to the next are named by rank with an
   external merge sort, and the string of names is sorted by recursion, until a
   string of names is small enough for prefix doubling in memory.
2. Sorted seeds go through a priority queue of suffixes by first symbol: what
   comes out in order induces the suffix before it, first all L suffixes in
   rising, then all S suffixes in falling order.
3. With each suffix travels the common prefix that it has with the one before
   it in its bucket: one more than the least common prefix between the suffixes
   that induced them.

A queue holds blocks of (position, common prefix) for each first symbol; as
suffixes are induced in order, each bucket is filled in order.  Blocks, texts,
types and names go to a scratch folder of the task once a memory bound is
reached (as Spark's own spills do; the folder is deleted with the task), so
that a text may be far larger than memory.  Common prefixes are cut at
``depth``, and suffixes that agree so far count as equal.
"""

from __future__ import annotations

import heapq
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Suffixes of a block.
BLOCK = 1 << 16
#: Bytes that a task's arrays and queues take in memory; what is beyond goes to its scratch folder.
MEMORY = 256 << 20
#: Names that prefix doubling sorts in memory (about 80 bytes each).
IN_MEMORY = 1 << 21


class Scratch:
    """Arrays and blocks in memory up to a bound, in files of ``folder`` beyond it."""

    def __init__(self, folder: str, memory: int = MEMORY):
        self.folder, self.left, self.files, self.spilled = folder, memory, 0, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"scratch-{self.files}")

    def array(self, size: int, dtype) -> np.ndarray:
        """An array of zeros."""
        nbytes = size * np.dtype(dtype).itemsize
        if nbytes <= self.left or not size:
            self.left -= nbytes
            return np.zeros(size, dtype)
        self.spilled += nbytes
        return np.memmap(self.path(), dtype, "w+", shape=(size,))

    def free(self, array: np.ndarray) -> None:
        if isinstance(array, np.memmap):
            os.unlink(array.filename)
        else:
            self.left += array.nbytes

    def put(self, array: np.ndarray):
        """Keeps a block: what ``get`` takes to give it back."""
        if array.nbytes <= self.left:
            self.left -= array.nbytes
            return array
        self.spilled += array.nbytes
        path = self.path()
        array.tofile(path)
        return path, array.dtype

    def get(self, kept) -> np.ndarray:
        return kept if isinstance(kept, np.ndarray) else np.fromfile(kept[0], kept[1])

    def drop(self, kept) -> None:
        if isinstance(kept, np.ndarray):
            self.left += kept.nbytes
        else:
            os.unlink(kept[0])


class Bucket:
    """Suffixes with the same first symbol, in the order in which they were induced."""

    __slots__ = ("blocks", "tail", "rows", "read")

    def __init__(self):
        self.blocks: list = []  # kept by Scratch
        self.tail: list[np.ndarray] = []
        self.rows = 0  # in the tail
        self.read = 0  # blocks that were taken

    def seal(self, scratch: Scratch) -> None:
        if self.tail:
            self.blocks.append(scratch.put(np.concatenate(self.tail) if len(self.tail) > 1 else self.tail[0]))
            self.tail, self.rows = [], 0

    def push(self, suffixes: np.ndarray, scratch: Scratch) -> None:
        self.tail.append(suffixes)
        self.rows += len(suffixes)
        if self.rows >= BLOCK:
            self.seal(scratch)

    def take(self, scratch: Scratch) -> np.ndarray | None:
        """The next block that was not taken yet, None if there is none."""
        if self.read == len(self.blocks):
            self.seal(scratch)
            if self.read == len(self.blocks):
                return None
        self.read += 1
        return scratch.get(self.blocks[self.read - 1])


class SuffixQueue:
    """A priority queue of suffixes by first symbol, and what is needed to find common prefixes of what is pushed."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, scratch: Scratch, falling: bool, kind: np.dtype):
        self.text, self.depth, self.scratch, self.sign, self.kind = text, depth, scratch, -1 if falling else 1, kind
        self.buckets: dict[int, Bucket] = defaultdict(Bucket)
        self.heap: list[int] = []
        self.seen = 0  # suffixes that came by
        self.last = scratch.array(symbols, np.int64)  # 1 + number of the suffix that last pushed to a bucket
        # least common prefix from each of some suffixes to now, rising; at most depth + 1 of them
        self.at, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(self) -> None:
        self.scratch.free(self.last)

    def top(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self) -> Bucket:
        """The bucket of the top symbol; it may still get suffixes while its own come by."""
        return self.buckets[self.sign * heapq.heappop(self.heap)]

    def _put(self, symbol: int, suffixes: np.ndarray, current: int | None) -> None:
        if symbol not in self.buckets and symbol != current:
            heapq.heappush(self.heap, self.sign * symbol)
        self.buckets[symbol].push(suffixes, self.scratch)

    def begin(self, position: int) -> None:
        """The empty suffix comes by first and induces the last position."""
        self._put(int(self.text[position]), np.array([(position, 0)], self.kind), None)
        self.last[self.text[position]], self.seen = 1, 1
        self.at, self.least = np.array([0]), np.array([0])

    def _least(self, low: np.ndarray, high: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The least of prefix[low..high], both ends included, for each pair."""
        length = high - low + 1
        level = np.frexp(length.astype(np.float64))[1] - 1
        found, table = np.empty(len(low), np.int64), prefix
        for k in range(int(level.max()) + 1):
            here = np.flatnonzero(level == k)
            found[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
            if k < level.max():
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return found

    def come_by(self, suffixes: np.ndarray, pushes, current: int) -> None:
        """A block comes by in order, all with the first symbol ``current``; ``pushes(symbols before)`` tells which suffixes before them are induced."""
        position, prefix = suffixes["position"].astype(np.int64), np.ascontiguousarray(suffixes["prefix"])
        base, self.seen = self.seen, self.seen + len(position)
        inner = np.flatnonzero(position > 0)
        before = self.text[position[inner] - 1]  # in the text's own type: bytes are sorted by radix
        wanted = pushes(before)
        inner, before = inner[wanted], before[wanted]
        if len(inner):
            order = np.argsort(before, kind="stable")
            before, at = before[order].astype(np.int64), inner[order]
            starts = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
            low = np.empty_like(at)
            low[1:] = at[:-1] + 1
            low[starts] = 0
            least = self._least(low, at, prefix)
            last = self.last[before[starts]] - 1
            k = np.searchsorted(self.at, last, side="right")
            earlier = np.append(self.least, self.depth)[k]
            least[starts] = np.where(last < 0, -1, np.minimum(least[starts], earlier))
            induced = np.empty(len(at), self.kind)
            induced["position"], induced["prefix"] = position[at] - 1, np.minimum(least + 1, self.depth)
            ends = np.append(starts[1:], len(at))
            self.last[before[starts]] = base + at[ends - 1] + 1
            for symbol, a, b in zip(before[starts].tolist(), starts.tolist(), ends.tolist()):
                self._put(symbol, induced[a:b], current)
        falling = np.minimum.accumulate(prefix[::-1])[::-1]
        keep = np.flatnonzero(np.append(falling[:-1] < falling[1:], True))
        older = self.least < falling[0]
        self.at, self.least = np.concatenate([self.at[older], base + keep]), np.concatenate([self.least[older], falling[keep]])


def _run(text: np.ndarray, position: int, depth: int) -> int:
    """How often the symbol at ``position`` stands there in a row, up to ``depth``."""
    piece = text[position : position + depth]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """1 for positions of type S, 0 for L; the end of the text is smaller than any symbol."""
    n = len(text)
    types = scratch.array(n, np.uint8)
    after, after_type = -1, 0
    for stop in range(n, 0, -BLOCK * 16):
        start = max(0, stop - BLOCK * 16)
        here = text[start:stop].astype(np.int64)
        following = np.append(here[1:], after)
        decided = here != following
        smaller = (here < following).astype(np.uint8)
        nearest = np.where(decided, np.arange(len(here)), len(here))
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        types[start:stop] = np.append(smaller, np.uint8(after_type))[nearest]
        after, after_type = int(here[0]), int(types[start])
    return types


def _seeds(types: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of type S behind one of type L."""
    n, found, count = len(types), [], 0
    for start in range(1, n, BLOCK * 16):
        stop = min(n, start + BLOCK * 16)
        at = np.flatnonzero((types[start:stop] == 1) & (types[start - 1 : stop - 1] == 0)) + start
        found.append(scratch.put(at))
        count += len(at)
    seeds, filled = scratch.array(count, np.int64), 0
    for kept in found:
        at = scratch.get(kept)
        seeds[filled : filled + len(at)] = at
        filled += len(at)
        scratch.drop(kept)
    return seeds


_RECORD = np.dtype([("label", "<i8"), ("key", "<u8"), ("index", "<i8")])


def _sorted(blocks: Iterator[np.ndarray], scratch: Scratch, rows: int) -> Iterator[np.ndarray]:
    """Records in order of label and key, by an external merge sort with runs of ``rows``."""

    def ordered(parts: list[np.ndarray]) -> np.ndarray:
        all_rows = np.concatenate(parts)
        same = all_rows["label"][0] == all_rows["label"][-1] and not (all_rows["label"] != all_rows["label"][0]).any()
        return all_rows[np.argsort(all_rows["key"]) if same else np.lexsort((all_rows["key"], all_rows["label"]))]

    runs, parts, held = [], [], 0
    for block in blocks:
        parts.append(block)
        held += len(block)
        if held >= rows:
            runs.append(ordered(parts))
            path = scratch.path()
            runs[-1].tofile(path)
            runs[-1], parts, held = path, [], 0
    if not runs:
        if held:
            yield ordered(parts)
        return
    if held:
        path = scratch.path()
        ordered(parts).tofile(path)
        runs.append(path)
    parts = []
    scratch.spilled += sum(os.path.getsize(p) for p in runs)
    each = max(16, rows // len(runs))
    files = [open(p, "rb") for p in runs]  # noqa: SIM115
    buffers = [np.fromfile(f, _RECORD, each) for f in files]
    while any(map(len, buffers)):
        # all that is not beyond the least last record of a buffer is here
        label, key = min((b["label"][-1], b["key"][-1]) for b in buffers if len(b))
        ready = []
        for i, b in enumerate(buffers):
            n = int(np.count_nonzero((b["label"] < label) | ((b["label"] == label) & (b["key"] <= key))))
            ready.append(b[:n])
            buffers[i] = b[n:] if n < len(b) else np.fromfile(files[i], _RECORD, each)
        yield ordered([r for r in ready if len(r)])
    for f, p in zip(files, runs):
        f.close()
        os.unlink(p)


def _names(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, symbols: int, scratch: Scratch, rows: int) -> np.ndarray:
    """A number for the substring from each seed to the next: equal for equal ones, in their order."""
    m, n = len(seeds), len(text)
    bits = (2 * symbols).bit_length()
    width = 63 // bits
    names = scratch.array(m, np.int64)

    def keys(index: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """The next symbols (with types) of some substrings as numbers, and which go on behind them."""
        start = seeds[index]
        last = np.where(index + 1 < m, seeds[np.minimum(index + 1, m - 1)], n - 1)
        key = np.zeros(len(index), np.uint64)
        for k in range(width):
            at = start + (done + k)
            inside = at <= last
            at = np.minimum(at, n - 1)
            symbol = np.where(inside, 2 * text[at].astype(np.int64) + types[at] + 1, 0).astype(np.uint64)
            key = (key << np.uint64(bits)) | symbol
        return key, start + (done + width) <= last

    def first() -> Iterator[np.ndarray]:
        for a in range(0, m, BLOCK * 4):
            index = np.arange(a, min(m, a + BLOCK * 4))
            block = np.zeros(len(index), _RECORD)
            block["index"], block["key"] = index, keys(index, 0)[0]
            yield block

    blocks, done = first(), 0
    while blocks is not None:
        done += width
        unfinished = []
        seen, label_before, key_before, group, cls = 0, None, None, 0, 0
        for block in _sorted(blocks, scratch, rows):
            number = np.arange(seen, seen + len(block))
            label, key = block["label"], block["key"]
            new_group = np.append(seen == 0 or label[0] != label_before, label[1:] != label[:-1])
            new_class = new_group | np.append(seen == 0 or key[0] != key_before, key[1:] != key[:-1])
            groups = np.maximum.accumulate(np.where(new_group, number, group))
            classes = np.maximum.accumulate(np.where(new_class, number, cls))
            named = label + classes - groups
            names[block["index"]] = named
            seen, label_before, key_before, group, cls = seen + len(block), label[-1], key[-1], groups[-1], classes[-1]
            last = np.where(block["index"] + 1 < m, seeds[np.minimum(block["index"] + 1, m - 1)], n - 1)
            longer = np.flatnonzero(seeds[block["index"]] + done <= last)
            if len(longer):
                rest = np.zeros(len(longer), _RECORD)
                rest["label"], rest["index"] = named[longer], block["index"][longer]
                unfinished.append(scratch.put(rest))

        def following(kept: list, done: int) -> Iterator[np.ndarray]:
            for x in kept:
                block = scratch.get(x).copy()
                scratch.drop(x)
                block["key"] = keys(block["index"], done)[0]
                yield block

        blocks = following(unfinished, done) if unfinished else None
    return names


def _doubling(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names by their first ``depth`` symbols at least, and common prefixes with the one before."""
    m = len(names)
    order = np.argsort(names)
    ordered = names[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(m + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    rank[m] = -1
    levels, h = [rank], 1
    while h < depth:
        # classes of more than one suffix, in place
        ordered = rank[order]
        new = np.append(ordered[1:] != ordered[:-1], True)
        single = new & np.append(True, new[:-1])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        who = order[open_]
        key = (ordered[open_].astype(np.int64) << 32) | (rank[np.minimum(who + h, m)].astype(np.int64) + 1)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[open_] = who
        changed = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(changed, open_, 0))
        levels.append(rank)
        h *= 2
    a, b, common = order[1:].copy(), order[:-1].copy(), np.zeros(m, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        r = levels[k]
        step = (r[a] == r[b]) * (1 << k)
        a, b = np.minimum(a + step, m), np.minimum(b + step, m)
        common[1:] += step
    return order, np.minimum(common, depth)


def _seed_prefixes(text: np.ndarray, seeds: np.ndarray, one: np.ndarray, other: np.ndarray, common: np.ndarray, depth: int, names_depth: int) -> np.ndarray:
    """Common prefixes in symbols of seeds ``one`` and ``other`` whose strings of names have ``common`` names in common."""
    m, n = len(seeds), len(text)
    whole = common >= names_depth
    i, j = np.minimum(one + common, m - 1), np.minimum(other + common, m - 1)
    found = np.where(whole, depth, np.minimum(seeds[i] - seeds[one], depth))
    # the names there differ, so some symbol of them does (or its type does, at the end of a run that goes on beyond them)
    at = np.flatnonzero(found < depth)
    while len(at):
        p, q = seeds[one[at]] + found[at], seeds[other[at]] + found[at]
        inside = (p < n) & (q < n)
        at, p, q = at[inside], p[inside], q[inside]
        equal = text[p] == text[q]
        at = at[equal]
        found[at] += 1
        at = at[found[at] < depth]
    return found


def suffixes(text: np.ndarray, symbols: int, depth: int, scratch: Scratch, in_memory: int = IN_MEMORY) -> Iterator[np.ndarray]:
    """All suffixes in falling order of their first ``depth`` symbols, as blocks of (position, prefix).

    prefix: symbols in common with the suffix that came just before, up to
    ``depth``.  ``text``: integers from 0 to ``symbols`` - 1.
    """
    n = len(text)
    if not n:
        return
    kind = np.dtype([("position", "<u4" if n < 1 << 32 else "<i8"), ("prefix", "<u2")])
    types = _types(text, scratch)
    seeds = _seeds(types, scratch)
    names = _names(text, types, seeds, symbols, scratch, max(1024, in_memory)) if len(seeds) else np.zeros(0, np.int64)
    scratch.free(types)

    def sorted_seeds() -> Iterator[np.ndarray]:
        m, names_depth = len(seeds), depth // 2 + 1  # a name covers two symbols or more up to the next
        if m <= in_memory:
            every, shared = _doubling(np.asarray(names), names_depth) if m else (np.zeros(0, np.int64),) * 2
            parts = ((every[a : a + BLOCK], shared[a : a + BLOCK], every[a - 1] if a else -1) for a in range(0, m, BLOCK))
        else:
            parts = rising(names_depth)
        for order, common, before in parts:
            other = np.append(before, order[:-1])
            prefix = _seed_prefixes(text, seeds, order, np.maximum(other, 0), common, depth, names_depth)
            prefix[other < 0] = 0
            block = np.empty(len(order), kind)
            block["position"], block["prefix"] = seeds[order], prefix
            yield block

    def rising(names_depth: int) -> Iterator[tuple]:
        """The names' suffixes by recursion, from the last block to the first."""
        kept = [scratch.put(b) for b in suffixes(names, len(names), names_depth, scratch, in_memory)]
        before = -1
        while kept:
            block = scratch.get(kept[-1])
            order = block["position"][::-1].astype(np.int64)
            # what a suffix has in common with the smaller one stands with the smaller one
            common = block["prefix"][::-1].astype(np.int64)
            with_before = np.append(smaller if before >= 0 else 0, common[:-1])
            yield order, with_before, before
            before, smaller = int(order[-1]), int(common[-1])
            scratch.drop(kept.pop())

    # L suffixes, rising
    rising_queue = SuffixQueue(text, symbols, depth, scratch, False, kind)
    rising_queue.begin(n - 1)
    stream = sorted_seeds()
    waiting = next(stream, None)
    while rising_queue.heap or waiting is not None:
        seed_symbol = None if waiting is None else int(text[int(waiting["position"][0])])
        symbol = rising_queue.top()
        symbol = seed_symbol if symbol is None or (seed_symbol is not None and seed_symbol < symbol) else symbol
        seam = 0
        if rising_queue.top() == symbol:
            bucket, block = rising_queue.pop(), None
            while (taken := bucket.take(scratch)) is not None:
                block = taken
                rising_queue.come_by(block, lambda before: before >= symbol, symbol)
            seam = _run(text, int(block["position"][-1]), depth)
        first = True
        while waiting is not None and (first or int(text[int(waiting["position"][0])]) == symbol) and seed_symbol == symbol:
            inside = text[waiting["position"].astype(np.int64)] == symbol
            cut = len(waiting) if inside.all() else int(np.argmin(inside))
            block, waiting = waiting[:cut].copy(), waiting[cut:]
            if first:
                block["prefix"][0] = min(seam, _run(text, int(block["position"][0]), depth))
            rising_queue.come_by(block, lambda before: np.ones(len(before), bool), symbol)
            first = False
            if not len(waiting):
                waiting = next(stream, None)
    rising_queue.close()
    scratch.free(names)
    scratch.free(seeds)
    larger = rising_queue.buckets

    # S suffixes, falling, between the L suffixes
    queue = SuffixQueue(text, symbols, depth, scratch, True, kind)
    left = sorted(larger, reverse=True)
    at = 0
    while queue.heap or at < len(left):
        symbol = queue.top()
        symbol = left[at] if symbol is None or (at < len(left) and left[at] > symbol) else symbol
        seam = 0
        if queue.top() == symbol:
            bucket, block = queue.pop(), None
            while (taken := bucket.take(scratch)) is not None:
                block = taken
                yield block
                queue.come_by(block, lambda before: before <= symbol, symbol)
                scratch.drop(bucket.blocks[bucket.read - 1])
            seam = _run(text, int(block["position"][-1]), depth)
        if at < len(left) and left[at] == symbol:
            blocks = larger[symbol].blocks
            prefix = None
            while blocks:
                block = scratch.get(blocks[-1])[::-1].copy()
                own = block["prefix"].copy()
                # what stands with the larger one of two goes with the smaller one, which now comes second
                block["prefix"][1:] = own[:-1]
                block["prefix"][0] = min(seam, _run(text, int(block["position"][0]), depth)) if prefix is None else prefix
                prefix = own[-1]
                yield block
                queue.come_by(block, lambda before: before < symbol, symbol)
                scratch.drop(blocks.pop())
            at += 1
    queue.close()


def repeats(text: np.ndarray, depth: int, scratch: Scratch, in_memory: int = IN_MEMORY) -> np.ndarray:
    """For every position of a text of bytes: whether the ``depth`` bytes from there start at another position too."""
    marks = scratch.array(len(text), np.bool_)
    before = None
    for block in suffixes(text, 256, depth, scratch, in_memory):
        position, long = block["position"].astype(np.int64), block["prefix"] >= depth
        marks[position[long]] = True
        with_before = np.append(-1 if before is None else before, position[:-1])
        marks[with_before[long]] = True
        before = position[-1]
    return marks
