"""The filter audit against applying the filters one after the other."""

import itertools
import re

import pytest

from treelens.llm import audit


def by_hand(docs, labels):
    """Rows of the audit: every order applied to lists of documents."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    found = []
    for part in {d[2] or "" for d in docs}:
        facts = []
        for doc_id, text, lang in docs:
            if (lang or "") != part:
                continue
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            fails = {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs),
            }
            facts.append((doc_id, fails))
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(facts)
            for step, letter in enumerate(order, 1):
                gone = [f for f in facts if f not in alive]
                removed = [f for f in alive if f[1][letter]]
                alive = [f for f in alive if not f[1][letter]]
                shapley[letter] += len(removed)
                only = sum(f[1][letter] and sum(f[1].values()) == 1 for f in facts)
                rows.append((part, order, step, len(alive), len(removed), sum(f[1][letter] for f in gone), only, sum(f[0] in good for f in removed), sum(f[0] in toxic for f in removed)))
        found += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(found)


def test_all_orders(spark):
    long = " ".join(f"word{i}" for i in range(220))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long + " $", "en"), (4, "same " * 250, "en"), (5, "LOUD " * 9, "de"), (6, None, None), (7, "", ""), (8, "a|b", "de"),
        (9, long.upper(), "en"), (10, long, "de"), (None, long, "en"), (12, "one #", None), (12, "one #", None), (13, "one #", "fr"), (14, "é " * 300, "fr"), (15, " ".join(f"w{i % 110}" for i in range(220)), "fr"), (16, "x" * 300_000, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1), (99, 1, 1), (6, None, 1)]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, mask int")
    rows = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows.columns == ["part", "filter_order", "step", *audit.OUTCOMES, "shapley"]
    assert sorted(map(tuple, rows.collect())) == by_hand(docs, labels)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_fields_keep_apart():
    one, two = audit.step_fields(0b00101, True, False), audit.step_fields(0, False, True)
    n = (1 << 62) + 12345  # of many documents too
    assert audit.unpack(n * audit.pack(one) + 3 * audit.pack(two)) == [n * a + 3 * b for a, b in zip(one, two)]
    assert len(one) == audit.STEPS * len(audit.OUTCOMES) and audit.STEPS == 600
    with pytest.raises(OverflowError):
        audit.pack([1 << audit.FIELD_BITS])
