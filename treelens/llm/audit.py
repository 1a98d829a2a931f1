"""Interaction audit of five filters: what each removes in every order of application.

Every document gets a mask of the filters that it fails.  A mask maps to one
big integer whose fields hold what happens to such a document at all 600 steps
(120 orders of five filters); documents are audited by adding integers, never
by applying filters in an order.  Each task adds up its own documents, the sums
of tasks are added in two rounds, and one integer for each part is unpacked.

A field has 64 bits and counts documents, at most once each, so no sum of a
table whose rows a long can count runs over into the next field.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, save

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
STEPS = len(ORDERS) * len(FILTERS)
#: Bits of a field.
FIELD_BITS = 64
#: What a field counts, in the order of the fields of one step.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a packed integer; the sums of tasks meet in so many lots first.
_BYTES = STEPS * len(OUTCOMES) * FIELD_BITS // 8
LOTS = 512


def step_fields(mask: int, good: bool, toxic: bool) -> list[int]:
    """The outcomes of all steps for one document: 600 times the OUTCOMES, each 0 or 1."""
    fields: list[int] = []
    for order in ORDERS:
        alive = True
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed, redundant = alive and fails, fails and not alive
            alive = alive and not fails
            fields += [alive, removed, redundant, mask == bit, removed and good, removed and toxic]
    return [int(x) for x in fields]


def pack(fields: list[int], bits: int = FIELD_BITS) -> int:
    """Fields as one integer, the first in the lowest bits; OverflowError if one does not fit."""
    return int.from_bytes(b"".join(x.to_bytes(bits // 8, "little") for x in fields), "little")


def unpack(total: int, bits: int = FIELD_BITS) -> list[int]:
    """All fields of a sum of packed integers."""
    size = bits // 8
    raw = total.to_bytes(STEPS * len(OUTCOMES) * size, "little")
    return [int.from_bytes(raw[i : i + size], "little") for i in range(0, len(raw), size)]


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest`` and ``fails_a`` to ``fails_d`` of every row; a null text is empty, a null lang the empty string."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    return rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.size("words") < 200).alias("fails_a"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("fails_b"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]", "")) > 3 * F.length("text")).alias("fails_c"),
        F.col("text").rlike("[#$%&*|]").alias("fails_d"),
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs``: bit 0 of the mask is filter A, bit 4 filter E.

    E looks at the whole table: a text fails if a smaller doc_id has it, removed
    or not.  Only fingerprints move.  The smallest id of each text is found with
    partial minima in every task, and meets its row again by id and digest
    together, a key that no group of copies makes hot.  A null doc_id is no
    smaller id and has none, so it passes E; rows that repeat the smallest id
    all pass.  Of several labels of an id, one with the value 1 decides.
    """
    rows = save(failures(docs), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("good or toxic")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    fails = [F.col(f"fails_{letter.lower()}") for letter in FILTERS[:-1]] + [copy]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    found = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return found.select("part", mask.cast("int").alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows for each part.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic.  Filters
    (see FILTERS): A under 200 words, B less than half of the words distinct, C
    more than 3 % capitals A-Z, D any of ``#$%&*|``, E a copy of a smaller
    doc_id's text.  Null texts are empty (and copies of each other), null and
    empty lang are one part, repeated rows count each, extra columns are
    ignored, an empty table has no parts.  shapley: what the step's filter
    removes, summed over all orders at whatever step it stands.
    """

    def batch_sums(batches):
        known: dict[int, int] = {}
        totals: dict[str, int] = {}
        for batch in batches:
            code = batch["mask"] + 32 * batch["good"] + 64 * batch["toxic"]
            for (part, c), n in code.groupby([batch["part"], code]).size().items():
                if c not in known:
                    known[c] = pack(step_fields(c & 31, bool(c & 32), bool(c & 64)))
                totals[part] = totals.get(part, 0) + int(n) * known[c]
        yield pd.DataFrame([(part, x.to_bytes(_BYTES, "little")) for part, x in totals.items()], columns=["part", "packed"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(int.from_bytes(x, "little") for x in group["packed"])
        return pd.DataFrame([(group["part"].iloc[0], total.to_bytes(_BYTES, "little"))], columns=["part", "packed"])

    def unpacked(group: pd.DataFrame) -> pd.DataFrame:
        part, fields = group["part"].iloc[0], unpack(sum(int.from_bytes(x, "little") for x in group["packed"]))
        rows, shapley = [], dict.fromkeys(FILTERS, 0)
        for at, (order, step) in enumerate(itertools.product(ORDERS, range(1, len(FILTERS) + 1))):
            counts = fields[at * len(OUTCOMES) : (at + 1) * len(OUTCOMES)]
            shapley[order[step - 1]] += counts[OUTCOMES.index("removed")]
            rows.append((part, order, step, *counts))
        return pd.DataFrame([(*r, shapley[r[1][r[2] - 1]]) for r in rows], columns=["part", "filter_order", "step", *OUTCOMES, "shapley"])

    sums = masks(docs, labels).mapInPandas(batch_sums, "part string, packed binary")
    # the sums of any number of tasks, some hundred of them at a time
    lots = sums.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS))).groupBy("part", "lot").applyInPandas(added, "part string, packed binary")
    return lots.groupBy("part").applyInPandas(unpacked, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in (*OUTCOMES, "shapley")))
