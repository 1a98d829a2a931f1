import random
import re

from treelens.operators import tokens
from treelens.operators.tokens import TokenIndex
from treelens.schema import ENTRIES

ROW_TAIL = (False, 1, 1)


def table(spark, names):
    return spark.createDataFrame([(i + 1, 1, n, *ROW_TAIL) for i, n in enumerate(names)], ENTRIES)


def by_hand(names, text, prefix):
    """Every name tested, word by word."""
    found = set()
    for i, name in enumerate(names):
        own = tokens.words(name)
        good = bool(text.split()) and any(map(tokens.words, text.split()))
        for phrase in filter(None, map(tokens.words, text.split())):
            size = len(phrase)
            good = good and any(own[k : k + size - 1] == phrase[:-1] and (own[k + size - 1].startswith(phrase[-1]) if prefix else own[k + size - 1] == phrase[-1]) for k in range(len(own) - size + 1))
        if good:
            found.add(i + 1)
    return found


def test_index_against_every_name(spark):
    rnd = random.Random(4)
    vocabulary = ["red", "re", "ring", "rin", "Bolt", "café", "cafés", "STRASSE", "straße", "漢字", "x1", "7", "İzmir", "Ünï", "\U0001F600"]
    names = ["".join(rnd.choice(vocabulary) + rnd.choice([" ", "-", "_", ".", "'"]) for _ in range(rnd.randrange(1, 7))) for _ in range(300)] + ["", "...", "red red ring"]
    entries = table(spark, names)
    index = TokenIndex.build(entries)
    for text in ("red", "re", "red.ri", "red.red ring", "caf", "CAFÉ", "cafes bolt", "stra", "7 x", "漢", "izm", "uni.red", "ring ring.re", "none", "...", "", "r r r"):
        for prefix in (True, False):
            got = [r.id for r in index.ids(text, prefix).collect()]
            assert len(got) == len(set(got)) and set(got) == by_hand(names, text, prefix), (text, prefix)
    # the test of every name agrees
    for text in ("red.ring", "cafe", "bolt red"):
        assert {r.id for r in tokens.token_match(entries, text).collect()} == by_hand(names, text, False)


def test_patches_are_as_a_fresh_index(spark):
    names = {i: f"red-{i % 7} ring {i}" for i in range(1, 60)}
    frame = lambda d: spark.createDataFrame([(i, 1, n, *ROW_TAIL) for i, n in d.items()], ENTRIES)
    index = TokenIndex.build(frame(names))
    steps = [({5: "blue ring", 61: "red ring new"}, [7]), ({61: "green", 5: "red-3 ring back"}, [8, 62]), ({7: "red again"}, [])]
    for changed, gone in steps:
        names = {i: n for i, n in (names | changed).items() if i not in gone}
        ids = spark.createDataFrame([(i,) for i in [*changed, *gone]], "id long")
        index = index.patch(ids, frame(changed))
        fresh = TokenIndex.build(frame(names))
        for text in ("red", "ring", "blue", "red.ring", "new", "again", "r"):
            assert sorted(r.id for r in index.ids(text).collect()) == sorted(r.id for r in fresh.ids(text).collect())
    base = index.base.count()
    assert index.added.count() < 10 < base  # only changes were written


def test_too_many_changes_ask_for_a_new_index(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PATCH_LIMIT", 3)
    entries = table(spark, ["a b"] * 9)
    index = TokenIndex.build(entries)
    assert index.patch(entries.where("id <= 3").select("id"), entries.where("id <= 3")) is not None
    assert index.patch(entries.where("id <= 4").select("id"), entries.where("id <= 4")) is None


def test_scan_reads_the_range_only(spark, monkeypatch):
    """The ranges reach the Parquet reader, which skips row groups and pages of other words."""
    monkeypatch.setattr(tokens, "ROW_GROUP", 64 << 10)
    entries = spark.range(1, 60_001).selectExpr("id", "1L parent", "concat('n', id, ' word', pmod(id * 7919, 50000)) name", "false is_dir", "1L size", "1L modified")
    index = TokenIndex.build(entries)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan below is the one that runs
    try:
        found = index.ids("word123")
        read_a_range_only(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def read_a_range_only(found):
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(token,word123\).*LessThan\(token,word124\)", plan)
    assert plan.count("Exchange hashpartitioning") == 1
    assert found.count() > 100
    rows = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            rows.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    execution = found._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    walk(execution.executedPlan())
    assert rows and max(rows) < 0.3 * 120_000
