"""Suffix-array removal of repeated strings, and the external sort below it, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from treelens.llm import induced, substrings


def repeated(raw: bytes, depth: int) -> list[bool]:
    count = Counter(raw[i : i + depth] for i in range(len(raw) - depth + 1))
    return [i + depth <= len(raw) and count[raw[i : i + depth]] > 1 for i in range(len(raw))]


def by_hand(texts: list, length: int) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        found.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return found


@pytest.mark.parametrize("seed", range(60))
def test_suffixes_in_order_with_common_prefixes(seed, tmp_path, monkeypatch):
    """Small blocks, no memory and a base of few names force spills and deep recursion."""
    rnd = random.Random(seed)
    depth, letters = rnd.choice([1, 2, 3, 5, 8]), rnd.choice([b"a", b"ab", b"abc", bytes(range(97, 123)), bytes(range(256))])
    raw = bytes(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 10, 50, 300])))
    if rnd.random() < 0.5:
        at = rnd.randrange(len(raw))
        raw += raw[at : at + 20] + b"a" * rnd.randrange(10) + raw
    monkeypatch.setattr(induced, "BLOCK", rnd.choice([2, 7, 1 << 16]))
    scratch = induced.Scratch(str(tmp_path), rnd.choice([0, 500, 1 << 26]))
    text, base = np.frombuffer(raw, np.uint8), rnd.choice([2, 5, 1 << 20])
    assert induced.repeats(text, depth, scratch, base).tolist() == repeated(raw, depth)
    found = [x for block in induced.suffixes(text, 256, depth, scratch, base) for x in block.tolist()]
    heads = [raw[p : p + depth] for p, _ in found]
    assert sorted(p for p, _ in found) == list(range(len(raw))) and heads == sorted(heads, reverse=True)
    for (_, prefix), a, b in zip(found[1:], heads, heads[1:]):
        assert prefix == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_external_merge_sort_of_names(tmp_path):
    """Sorting in runs of a thousand records names as sorting at once does, and leaves no file behind but arrays."""
    rnd = random.Random(5)
    text = np.frombuffer(bytes(rnd.choice(b"abcd") for _ in range(40_000)), np.uint8)
    one, many = induced.Scratch(str(tmp_path), 1 << 30), induced.Scratch(str(tmp_path), 0)
    types = induced._types(text, one)
    seeds = induced._seeds(types, one)
    whole, merged = induced._names(text, types, seeds, 256, one, 1 << 30), induced._names(text, types, seeds, 256, many, 1000)
    assert whole.tolist() == list(merged) and many.spilled > 0 == one.spilled


@pytest.mark.parametrize("hot_runs, starts, base", [(2, 5, 4), (1 << 30, 1 << 15, 1 << 20)])
def test_documents(spark, hot_runs, starts, base):
    """Copies, shared passages of 11 to 13 bytes, periodic and long texts, split anchors, nulls, repeated rows, clashing names."""
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "漢字", "ete", "theta"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(60)]
    texts += [None, "", "short", "a" * 400, "ab" * 90, texts[0], "x" + texts[1], "twelve bytes", "twelve bytes!", "0123456789ab", "z0123456789abz", "y123456789ab.", " ".join(rnd.choice(words) for _ in range(3000))]
    ids = [*range(len(texts) - 3), None, None, 7]
    rows = [(i, t, "k", 1) for i, t in zip(ids, texts)]
    rows.append(rows[5])  # the same row twice
    texts.append(texts[5])
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, first int")
    found = substrings.dedupe(frame, 12, gram=4, shard_bytes=2000, hot_runs=hot_runs, starts=starts, memory=5000, in_memory=base)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    expected = [(r[0], *x) for r, x in zip(rows, by_hand(texts, 12))]
    assert sorted((tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert substrings.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_lengths(spark):
    """At 400 bytes: a passage of 400 goes, one of 399 stays; a copy loses all."""
    rnd = random.Random(3)
    fresh = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, b, own = fresh(400), fresh(399), fresh(900)
    texts = [fresh(300) + a + fresh(200), "1" + a, fresh(100) + "2" + b + "3", "4" + b + "5" + fresh(500), own, own, fresh(2000)]
    found = {r.doc_id: r.n_removed for r in substrings.dedupe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: 400, 1: 400, 2: 0, 3: 0, 4: 900, 5: 900, 6: 0}


def test_passages_of_over_fifty_words(spark):
    """Shared passages of 51 to 90 words go, once they are 400 bytes; n_removed and n_spans tell them, n_bytes is the input's length."""
    rnd = random.Random(51)
    fresh = lambda n, letters: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters)) for _ in range(n))
    texts, passages = [], []
    for words, letters in [(51, 7), (64, 6), (90, 4), (51, 6), (60, 5)]:
        passage = fresh(words, letters)
        texts += [f"{fresh(n, 6)} {passage} {fresh(n // 2, 6)}" for n in (40, 80)]
        passages += [passage] * 2
    texts += [fresh(n, 6) for n in (60, 150, 400)]
    passages += [None] * 3
    found = {r.doc_id: r for r in substrings.dedupe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    whole = [p is not None and len(p) >= 400 for p in passages]
    assert whole == [True] * 6 + [False] * 7
    for i, (text, passage) in enumerate(zip(texts, passages)):
        kept = found[i].kept.decode()
        assert found[i].n_bytes == len(text) and found[i].n_removed == len(text) - len(kept)
        assert found[i].n_spans == (1 if whole[i] else 0)
        assert kept.startswith(text[:200]) and passage not in kept if whole[i] else kept == text


def test_copies_are_marked_without_sorting(monkeypatch):
    """Segments that stand more than once are marked as a whole; they are sorted, once, only beside others that stand once."""
    rnd = random.Random(8)
    fresh = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    shared = fresh(30)
    rows = [
        (1, b"two", fresh(50), 2), (1, b"many", fresh(70), 9),  # copies alone
        (2, b"once", b"x" + shared + b"y", 1), (2, b"copied", b"z" + shared + fresh(10), 3),
        (3, b"single", fresh(25), 1),
    ]
    sorted_bytes = []
    whole = induced.repeats
    monkeypatch.setattr(induced, "repeats", lambda text, *more: sorted_bytes.append(len(text)) or whole(text, *more))

    class Shards:
        def mapInPandas(self, run, schema):  # noqa: N802
            frame = pd.DataFrame(rows, columns=["shard", "segment", "content", "n"])
            return list(run(iter([frame[:2], frame[2:3], frame[3:]])))

    found = pd.concat(substrings._mark(Shards(), 20, 1 << 20, 1 << 20))
    marks = sorted(found[["segment", "low", "high"]].itertuples(index=False, name=None))
    assert marks == [(b"copied", 0, 21), (b"many", 0, 50), (b"once", 1, 11), (b"two", 0, 30)]
    assert sorted_bytes == [33 + 42 + 26]
