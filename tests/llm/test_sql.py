"""The SQL forms and the operators agree on edge cases that the tables may lack."""

import random

import duckdb
import pandas as pd

from treelens.llm import queries


def _both(spark, tmp_path, name, rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "int64"})
    documents.to_parquet(tmp_path / "documents.parquet")
    frame = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(frame.columns)
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        found = connection.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted(names) == columns
    got = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return {row["doc_id"]: row for row in frame.collect()}


_ODD = [None, "", " \t\x0b\n", "one", "One two", "ONE two", "É two", "é two", "a\x1cb c d e f", "#*$ %&|<> x", "x\n\nx\ny x\n x"]


def test_near_duplicates(spark, tmp_path):
    dice = random.Random(3)
    base = [f"w{dice.randrange(300)}" for _ in range(103)]
    texts = [*_ODD, *[" ".join(base)] * 3]
    for cut in range(0, 60, 3):  # a chain, and sizes on both sides of the limit
        texts.append(" ".join(base[cut:]))
        texts.append(" ".join(base[cut:] + base[:cut]))
    found = _both(spark, tmp_path, "op7_near_duplicates", list(enumerate(texts)))
    assert {i for i in range(len(_ODD)) if not found[i]["kept"]} == {5}


def test_quality_rules(spark, tmp_path):
    dice = random.Random(4)

    def fresh(n):
        return [f"v{dice.randrange(10**9)}" for _ in range(n)]

    once, short = fresh(60), fresh(10)
    texts = [
        *_ODD, " ".join(once), " ".join(["same"] * 300), " ".join(fresh(70) + short * 5 + fresh(70)), " ".join(short * 9 + fresh(60)),
        " ".join(once + fresh(20) + once + fresh(90)),  # covered 120 of 230, too much for the base too
        " ".join(once + fresh(480) + once),  # covered a fifth, longest exactly a tenth
        " ".join(once + fresh(479) + once),  # one word less: a repeat over a tenth
        " ".join(sum((short + fresh(20) for _ in range(6)), []) + fresh(20)),  # 60 of 200 words in short repeats, the limit
        " ".join(sum((short + fresh(20) for _ in range(6)), []) + fresh(19)),  # one word less: too many
        " ".join(once + fresh(20) + once[:49] + fresh(90)), "\n".join([" ".join(once)] * 2 + ["", " "] * 3),
    ]
    found = _both(spark, tmp_path, "op8_quality_rules", list(enumerate(texts)))
    limit = len(_ODD) + 5
    assert not any(found[limit + k]["base_failed"] for k in range(4))
    assert [found[limit + k]["kept"] for k in range(4)] == [True, False, True, False]


def test_empty_tables(spark, tmp_path):
    for name in ("op7_near_duplicates", "op8_quality_rules"):
        documents = pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="string")})
        documents.to_parquet(tmp_path / "documents.parquet")
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0
