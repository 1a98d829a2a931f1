import threading

import pytest
from pyspark.sql import functions as F

from treelens import storage, store as stores
from treelens.errors import Conflict, StorageFailed
from treelens.operators import mutate
from treelens.plans.search import Catalog, Request, search
from treelens.schema import COLUMNS, ENTRIES
from treelens.store import CatalogStore


def tree(spark, extra=()):
    rows = [(1, 0, "", True, 0, 0), (2, 1, "home", True, 0, 5), (3, 1, "work", True, 0, 6)]
    rows += [(10 + i, 2 + i % 2, f"ring-{i % 5} bolt {i}.{'pdf' if i % 3 else 'txt'}", False, 100 * i, i) for i in range(40)]
    return spark.createDataFrame([*rows, *extra], ENTRIES)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def found(catalog, text, **more):
    return [tuple(r) for r in search(catalog, Request(text, sort_empty=True, **more)).orderBy("rank").collect()]


@pytest.fixture()
def store(spark, tmp_path):
    made = CatalogStore(spark, str(tmp_path / "store"))
    with made.transaction() as t:
        t.replace(tree(spark))
    return made


def test_empty_store_and_bulk_load(spark, tmp_path):
    made = CatalogStore(spark, str(tmp_path / "s"))
    assert made.version().number == 0 and made.catalog().entries.count() == 0
    whole = tree(spark)
    with made.transaction() as t:
        t.append(whole.where("id < 20"))
        t.append(whole.where("id >= 20"))
        assert storage.names(spark, f"{made.folder}/versions") == []  # nothing is there before the end
    v = made.version()
    assert (v.number, v.data, v.base_rows) == (1, 1, 43) and rows(made.catalog().entries) == rows(whole)
    assert {r.id for r in made.catalog().tokens.ids("ring.3").collect()} == {r.id for r in whole.where("name like 'ring-3%'").collect()}
    with pytest.raises(StorageFailed):
        made.version(9)


def test_patched_search_is_as_a_fresh_build(spark, store):
    base = store.version().base
    after = tree(spark).where("id <> 12").withColumn("name", F.when(F.col("id") == 14, F.lit("gear ring.mp3")).when(F.col("id") == 3, F.lit("office")).otherwise(F.col("name")))
    after = after.unionByName(spark.createDataFrame([(90, 3, "ring new.pdf", False, 1, 99), (91, 3, "sub", True, 0, 1), (92, 91, "deep ring.pdf", False, 7, 2)], ENTRIES))
    with store.transaction() as t:
        assert t.evolve(after)
    v = store.version()
    assert v.base == base and v.void_rows == 6 and v.data == 2  # the base stays; six ids differ
    fresh, patched = Catalog.stored(after), store.catalog()
    for text, more in (("ring", {}), ("", {"sort": "path"}), ("ext:pdf size:>500", {"sort": "size", "ascending": False}), ("in:/office", {}), ("parent:/office ring", {}), ("gear | new", {"limit": 2}), ("!ring", {"sort": "modified"})):
        assert found(patched, text, **more) == found(fresh, text, **more), text
    for text in ("ring", "ring.ne", "gear", "off"):
        assert sorted(r.id for r in patched.tokens.ids(text).collect()) == sorted(r.id for r in fresh.tokens.ids(text).collect())
    files = patched.rows.inputFiles()
    assert all(v.base in f or v.added in f or v.void in f for f in files)  # base and one layer of changes
    # a second patch joins the first layer; the first snapshot still reads as before
    with store.transaction() as t:
        t.patch(spark.createDataFrame([(90,), (14,), (15,)], "id long"), after.where("id = 15").withColumn("size", F.lit(9).cast("long")))
    again = after.where("id not in (90, 14)").withColumn("size", F.when(F.col("id") == 15, 9).otherwise(F.col("size")))
    assert rows(store.catalog().entries) == rows(again) and store.version().base == base
    assert found(store.catalog(), "ring") == found(Catalog.stored(again), "ring")
    assert rows(store.catalog(1).entries) == rows(tree(spark)) and rows(store.catalog(2).entries) == rows(after)
    with store.transaction() as t:
        assert not t.evolve(again)  # writes of what is there are no change
    assert store.version().data == 3


def test_past_the_limit_the_base_is_written_again(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "PATCH_LIMIT", 5)
    base = store.version().base
    with store.transaction() as t:
        assert t.evolve(tree(spark).withColumn("size", F.col("size") + F.lit(1)))
    assert store.version().base != base and store.version().void is None
    assert rows(store.catalog().entries) == rows(tree(spark).withColumn("size", F.col("size") + F.lit(1)))


def test_a_failed_transaction_leaves_nothing(spark, store):
    before = storage.names(spark, store.folder)
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.put("history", spark.range(3))
        t.patch(spark.createDataFrame([(10,)], "id long"), tree(spark).limit(0))
        assert t.entries.count() == 42
        raise RuntimeError("half way")
    assert store.version().number == 1 and rows(store.catalog().entries) == rows(tree(spark))
    assert [n for n in storage.names(spark, store.folder) if n != "pins"] == before or storage.names(spark, store.folder) == before
    # a write that fails in Spark too
    with pytest.raises(Exception), store.transaction() as t:  # noqa: B017
        t.append(tree(spark).withColumn("size", F.expr("raise_error('disk full')").cast("long")))
    assert store.version().number == 1 and not storage.names(spark, f"{store.folder}/pins")


def test_several_tables_change_together(spark, store):
    with store.transaction() as t:
        t.put("history", spark.createDataFrame([("ring", 1)], "text string, at long"))
        t.evolve(mutate.delete_ids(t.entries, spark.createDataFrame([(11,)], "id long")))
    assert store.table("history").collect()[0].text == "ring" and store.catalog().entries.count() == 42
    assert store.table("history", 1) is None


def test_of_two_writers_one_is_refused(spark, store):
    one = tree(spark).where("id <> 10")
    first, second = store.transaction(), store.transaction()
    a, b = first.__enter__(), second.__enter__()
    a.evolve(one)
    b.evolve(tree(spark).where("id <> 11"))
    first.__exit__(None, None, None)
    with pytest.raises(Conflict):
        second.__exit__(None, None, None)
    assert rows(store.catalog().entries) == rows(one) and store.numbers() == [1, 2]
    with store.transaction() as t:  # tried again on what is there now
        t.evolve(t.entries.where("id <> 11"))
    assert rows(store.catalog().entries) == rows(one.where("id <> 11"))


def test_only_one_of_many_claims_a_file(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(storage.write_text(spark, f"{tmp_path}/claim", str(k)))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won.count(True) >= 1 and storage.names(spark, str(tmp_path)).count("claim") == 1
    assert storage.write_text(spark, f"{tmp_path}/claim", "late") is False and storage.write_text(spark, f"{tmp_path}/claim", "new", replace=True)
    assert storage.read_text(spark, f"{tmp_path}/claim") == "new" and storage.read_text(spark, f"{tmp_path}/none") is None


def test_compaction_keeps_what_is_read(spark, store):
    with store.transaction() as t:
        t.evolve(tree(spark).where("id < 20"))
    assert not store.compact()  # far below 128 MiB
    reading = store.reading(1)
    old = reading.__enter__()
    assert store.compact(dead_bytes=1)
    v = store.version()
    assert v.number == 3 and v.void is None and v.base_rows == 13 and rows(store.catalog().entries) == rows(tree(spark).where("id < 20"))
    assert store.numbers() == [1, 3] and rows(old.entries) == rows(tree(spark))  # the reader's files are there
    assert found(old, "ring", limit=5) == found(Catalog.stored(tree(spark)), "ring", limit=5)
    reading.__exit__(None, None, None)
    assert store.expire() > 0 and store.numbers() == [3]
    assert {n for n in storage.names(spark, store.folder) if n.startswith("data-")} == v.folders()
    assert not store.compact(dead_bytes=1)  # nothing is dead now
