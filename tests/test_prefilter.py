"""Quick tests before patterns change no result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treelens.lang import compile as compiler
from treelens.lang.literal import required
from treelens.plans.search import Catalog, Request, matches, search
from treelens.schema import ENTRIES

NAMES = [
    "kelvin.txt", "KELVIN.TXT", "Kelvin.txt", "Kelvin.txt", "ſample.txt", "sample.txt", "SAMPLE.png", "straße.png", "STRASSE.PNG", "a.b", "a-b", "aab", "ab", "b", "red ring.pdf", "red-ring.pdf", "line\nend.png", "line end.png",
    "İstanbul.png", "x.png.bak", ".png", "png", "a[1].png", "a(1)|b.txt", "café.png", "CAFÉ.PNG", "k.k.k", "1234.csv", "aaa.aaa",
]


@pytest.mark.parametrize("pattern, text", [
    (r"^red.*\.(png|heic)$", "red"), (r"\.png$", ".png"), ("a|b", ""), ("(?i)abc", ""), ("ab?c", "a"), ("ab+c", "ab"), ("ab{0,2}c", "a"), ("ab{2}cd", "ab"), ("(?:abc)d", "d"), (r"\d+report\d", "report"), (r"\Qa.b\E", ""), ("[ab]xyz[^c]", "xyz"),
    ("x(?=abc)yz", "yz"), (r"a\.b\-c", "a.b-c"), (r"\x41bc", ""), ("café", "caf"), ("", ""), ("(a|b)cd", "cd"), ("ab*", "a"), ("[[a]b]cd", ""), ("[]a]cd", ""), (r"(\(x\))yy", "yy"), ("ab|", ""), ("a+b", "ab"),
])
def test_required(pattern, text):
    assert required(pattern) == text


@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(spark.createDataFrame([(1, 0, "", True, 0, 0)] + [(i + 2, 1, n, False, i, i) for i, n in enumerate(NAMES)], ENTRIES))


def test_patterns_find_the_same_with_and_without(spark, catalog):
    """Fuzzed patterns: those of many pieces, in both cases, in one job each way."""
    rnd = random.Random(8)
    piece = ["k", "s", "ss", "png", "a", "b", r"\.", ".", ".*", "[a-c]", "[^x]", "(a|b)", "(?:ring)?", "red", r"\d", r"\w", "+", "?", "*", "{2}", "{0,1}", "^", "$", "|", "K", "PNG", r"\-", " ", "é", "(", ")", "i"]
    patterns = {"kelvin", "sample", "^k", "K", "straße", "png$"}
    while len(patterns) < 160:
        text = "".join(rnd.choice(piece) for _ in range(rnd.randrange(1, 6)))
        try:
            spark._jvm.java.util.regex.Pattern.compile(text)
        except Exception:
            continue
        patterns.add(text)
    rows = catalog.rows
    for match_case in (True, False):
        quick = [compiler.regex_column(p, match_case, False).alias(f"q{i}") for i, p in enumerate(sorted(patterns))]
        plain = [F.col("name").rlike(compiler.regex(p, match_case)).alias(f"p{i}") for i, p in enumerate(sorted(patterns))]
        for r in rows.select("name", *quick, *plain).collect():
            for i, p in enumerate(sorted(patterns)):
                assert r[f"q{i}"] == r[f"p{i}"], (p, r.name, match_case)


def test_wildcards_find_the_same_as_patterns(catalog):
    texts = ["*.png", "*.PNG", "k*", "*lvin*", "s*", "*e", "*", "**png", "a*b", "?b", "*é.png", "*.p?g", "*end*", "*end.png", "*1]*"]
    for match_case in (True, False):
        quick = [compiler.wildcard_column(t, match_case, False).alias(f"q{i}") for i, t in enumerate(texts)]
        plain = [F.col("name").rlike(compiler.regex(compiler.glob(t), match_case)).alias(f"p{i}") for i, t in enumerate(texts)]
        for r in catalog.rows.select("name", *quick, *plain).collect():
            for i, t in enumerate(texts):
                assert r[f"q{i}"] == r[f"p{i}"], (t, r.name, match_case)


def test_memory_mode_is_read_and_released(spark):
    """A stored catalog that is cached is read from memory, and no longer once it is released."""
    stored = Catalog.stored(spark.createDataFrame([(1, 0, "", True, 0, 0), (2, 1, "ring.txt", False, 1, 1)], ENTRIES)).cache()
    plan = lambda: matches(stored, Request("ring"))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan()
    stored.release()
    assert "InMemoryTableScan" not in plan()


def test_small_pages_leave_no_files(spark, catalog):
    catalog.paths  # written once  # noqa: B018
    before = len(spark._treelens_folders)
    page = search(catalog, Request("", sort_empty=True, limit=5, offset=3))
    assert [r["rank"] for r in page.orderBy("rank").collect()] == [4, 5, 6, 7, 8] and len(spark._treelens_folders) == before
    whole = search(catalog, Request("", sort_empty=True, limit=5000)).orderBy("rank").collect()  # a large page, written
    assert [tuple(r) for r in search(catalog, Request("", sort_empty=True, limit=1000)).orderBy("rank").collect()] == [tuple(r) for r in whole]
    assert search(catalog, Request("nothing there")).count() == 0
