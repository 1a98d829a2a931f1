"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from treelens.llm import lexical


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, places):
    known = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    total, length = len(known), sum(n for *_, n in known)
    df = Counter(w for _, c, _ in known for w in c)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, count, n in known:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * count[w]) // (1000 * count[w] + 12 * m)) for w in words(text) if w in count)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored)[:places], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed, owners, bundle, block_bytes", [(1, (0.02, 0.1, 0.35, 1.0), 8192, 1 << 25), (2, (0.5, 1.0), 3, 1 << 25), (3, (1.0,), 2, 150), (4, (0.1, 0.2, 0.3, 0.6, 0.8, 1.0), 8192, 1 << 25)])
def test_best_documents(spark, monkeypatch, seed, owners, bundle, block_bytes):
    """Frequent and rare terms, pruning, ties, repeated rows and terms, nulls, long and empty texts, small shards, blocks."""
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "SCRATCH", 150)
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "Ä", "漢字", "x1"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rnd.choice([" ", "-", "_ "]).join(rnd.choices(vocabulary, weights, k=n))
    docs = [(i, text(rnd.randrange(0, 40))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "--- !"), (83, "THE the The"), (84, docs[3][1]), (85, docs[3][1]), (None, "w59 " * 3), (86, text(20_000)), docs[5], docs[5]]
    items = [(i, text(rnd.randrange(1, 12))) for i in range(12)] + [(20, None), (21, "unheard of"), (22, ""), (23, "w59 w59 w58"), (24, docs[3][1])]
    found = lexical.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), 5, owners, block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(docs, items, 5)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, spark.createDataFrame([(1, "unknown")], "item_id long, text string")).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == by_hand([(1, "some words")], [(1, "words")], 20)
