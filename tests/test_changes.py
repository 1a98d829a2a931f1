"""Changes of a catalog, row by row; the wired feed; the listing; what searches push down."""

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from treelens import schema, storage
from treelens.functions import highlight
from treelens.operators import hierarchy, mutate, reconcile
from treelens.plans import search as engine
from treelens.plans.search import Catalog, Request
from treelens.sources import adapters
from treelens.sources.adapters import from_paths
from treelens.streaming import checkpoint, feed

TREE = [("/a/b/f.txt", False, 5, 1), ("/a/g.txt", False, 6, 2), ("/h", False, 7, 3)]
EVENTS = "id long, path string, flags long"
EDIT = feed.MODIFIED | feed.IS_FILE


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_replaces_the_ids_of_files(spark):
    entries = from_paths(spark, TREE)
    ids = {r.name: r for r in entries.collect()}
    news = [(ids["b"].id, "f.txt", False, 5, 1, 900), (ids["a"].id, "b", True, 0, 0, 901), (ids["a"].id, "new", False, 1, 1, 902), (ids["a"].id, "g.txt", False, 6, 2, ids["g.txt"].id)]
    out = {r.name: r for r in mutate.upsert(entries, spark.createDataFrame(news, "parent long, name string, is_dir boolean, size long, modified long, id long")).collect()}
    assert (out["f.txt"].id, out["f.txt"].change) == (900, "update")
    assert (out["b"].id, out["b"].change) == (ids["b"].id, "none")  # a folder keeps its id, and so its children
    assert (out["new"].id, out["new"].change) == (902, "insert") and out["g.txt"].change == "none"
    twice = spark.createDataFrame([(ids["a"].id, "g.txt", False, n, 2, n) for n in (9, 3, 8)], "parent long, name string, is_dir boolean, size long, modified long, seq long")
    assert {r.size for r in mutate.upsert(entries, twice, "seq").where("name = 'g.txt'").collect()} == {9}
    assert {r.id for r in mutate.upsert(entries, twice, "seq").where("name = 'g.txt'").collect()} == {ids["g.txt"].id}


def test_versions_advance_only_with_changes(spark):
    entries = from_paths(spark, TREE)
    ids = {r.name: r.id for r in entries.collect()}
    same = entries.where("not is_dir").select("parent", "name", "is_dir", "size", "modified")
    assert mutate.advance(7, entries, mutate.upsert(entries, same)) == 7
    assert mutate.advance(7, entries, mutate.upsert(entries, same.withColumn("size", F.col("size") + 1))) == 8
    missing, known = (spark.createDataFrame([(i,)], "id long") for i in (10**6, ids["h"]))
    assert mutate.advance(7, entries, mutate.delete_ids(entries, missing)) == 7 and mutate.advance(7, entries, mutate.delete_ids(entries, known)) == 8
    assert mutate.advance(0, entries.limit(0), entries.limit(0)) == 0
    after = entries.withColumn("size", F.when(F.col("name") != "f.txt", F.col("size"))).where("name <> 'h'").unionByName(entries.where("name = 'h'").withColumn("id", F.lit(10**6).cast("long")))
    assert dict(rows(mutate.changes(entries, after).where(F.col("id").isin(ids["f.txt"], ids["h"], 10**6)))) == {ids["f.txt"]: "update", ids["h"]: "delete", 10**6: "insert"}
    assert mutate.changes(after, after).isEmpty()  # null sizes are equal


def test_a_file_gives_way_to_a_folder(spark):
    entries = from_paths(spark, TREE)
    out = mutate.ensure_folders(entries, spark.createDataFrame([("/a/g.txt/deep",), ("/a/b",)], "path string"))
    found = hierarchy.with_paths(out, hierarchy.folder_paths(out)).select("path", "is_dir")
    assert rows(found) == [("/", True), ("/a", True), ("/a/b", True), ("/a/b/f.txt", False), ("/a/g.txt", True), ("/a/g.txt/deep", True), ("/h", False)]


def test_point_checks(spark):
    schema_ = "path string, is_dir boolean, size long, modified double"
    stored = spark.createDataFrame([("/a/same", False, 1, 5.0), ("/a/other", False, 1, 5.0), ("/a/gone", False, 1, 5.0), ("/a/dir", True, 0, 0.0)], schema_)
    observed = spark.createDataFrame([("/a/same", False, 1, 5.7), ("/a/other", False, 2, 5.0), ("/a/new", False, 1, 5.0), ("/x/y", False, 1, 1.0), ("/a/dir", False, 3, 1.0), ("/a/grown", True, 0, 0.0)], schema_)
    folders = spark.createDataFrame([("/a",), ("/",)], "path string")
    changed = stored.select("path").unionByName(observed.select("path")).unionByName(spark.createDataFrame([("/a/never",)], "path string"))
    want = {"/a/same": "none", "/a/other": "update", "/a/gone": "delete", "/a/new": "insert", "/x/y": "parent", "/a/dir": "directory", "/a/grown": "directory", "/a/never": "none"}
    assert dict(rows(reconcile.point_check(changed, stored, observed, folders))) == want


def test_feed_waits_retries_and_keeps_its_cursor(spark):
    now, applied, broken = [100.0], [], []

    def apply(changes, batch_id):
        if broken:
            raise OSError("busy")
        applied.append(sorted((r.path, r.first_id, r.id) for r in changes.collect()))

    f = feed.Feed(spark, ["/r"], apply, clock=lambda: now[0])

    def batch(*events):
        return f.batch(spark.createDataFrame(list(events), EVENTS))

    assert batch((10, "/r/x", EDIT)).cursor == 10 and applied[-1] == [("/r/x", 10, 10)]
    now[0] = 102
    state = batch((20, "/r/x", EDIT), (40, "/r/x", EDIT), (50, "/r/y", EDIT))
    assert applied[-1] == [("/r/y", 50, 50)] and state.cursor == 19  # /r/x waits since 20
    now[0] = 106
    assert batch().cursor == 50 and applied[-1] == [("/r/x", 20, 40)]
    broken.append(True)
    now[0] = 120
    with pytest.raises(OSError):
        batch((60, "/r/z", EDIT), (70, "/", feed.HISTORY_DONE))
    assert f.state.cursor == 50 and not f.state.history and rows(f.pending().select("path", "id")) == [("/r/z", 60)]
    broken.clear()
    state = batch((80, "/r/z", EDIT))
    assert applied[-1] == [("/r/z", 60, 80)] and state.cursor == 80
    assert batch((90, "/r", feed.HISTORY_DONE)).history and f.state.cursor == 90
    # paths beyond the bound: the root as a whole
    f.max_pending = 2
    batch(*[(100 + k, f"/r/f{k}", EDIT) for k in range(5)])
    assert applied[-1] == [("/r", 100, 104)]


def test_feed_translates_paths(spark):
    seen = []
    mappings = spark.createDataFrame([("/private/data", "/data")], "canonical string, configured string")
    f = feed.Feed(spark, ["/data"], lambda changes, _: seen.extend(r.path for r in changes.collect()), mappings=mappings)
    f.batch(spark.createDataFrame([(1, "/private/data/x", EDIT), (2, "/data/y", EDIT)], EVENTS))
    assert sorted(seen) == ["/data/x", "/data/y"]


def test_listing_is_walked_by_the_executors(spark, tmp_path):
    for name in ("a/b/c", "skip/deep", "empty"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "a/f.txt").write_text("12345")
    (tmp_path / "a/b/g").write_text("1")
    (tmp_path / "skip/deep/h").write_text("1")
    (tmp_path / "a/loop").symlink_to(tmp_path)
    got = adapters.listing(spark, str(tmp_path), skip=lambda path, name: name == "skip")
    names = {f"{r.directory[len(str(tmp_path)):]}/{r['name']}": r for r in got.collect()}
    assert set(names) == {"/a", "/skip", "/empty", "/a/f.txt", "/a/b", "/a/loop", "/a/b/g", "/a/b/c"}
    assert names["/a/f.txt"].size == 5 and names["/a/loop"].is_symlink and names["/a/b"].is_dir
    assert [r.failure for r in adapters.listing(spark, str(tmp_path / "none")).collect()] == ["missing"]
    config = reconcile.ScanConfig(("/",), patterns=("g",))
    kept = reconcile.filter_listing(got.where("failure is null"), config)
    assert {r["name"] for r in kept.collect()} == {"a", "skip", "empty", "f.txt", "b", "loop", "c"}
    assert not kept.where("name = 'loop' and is_dir").count()


def test_deletes_near_unavailable_places_are_held_back(spark):
    deletes = spark.createDataFrame([("/v/x",), ("/v",), ("/",), ("/w/y",)], "path string")
    assert rows(reconcile.guarded_deletes(deletes, spark.createDataFrame([("/v",)], "path string"))) == [("/w/y",)]
    entries = from_paths(spark, TREE)
    failed = spark.createDataFrame([(1, "missing"), (2, "denied"), (3, "other"), (99, "missing")], "id long, reason string")
    assert rows(reconcile.resolve_failed_reads(entries, failed)) == [(1, "delete"), (2, "keep"), (3, "error")]


def test_filters_reach_the_scan(spark):
    catalog = Catalog.stored(from_paths(spark, TREE))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = engine.matches(catalog, Request("size:>4 ext:txt"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(size,5)" in plan and "EqualTo(ext,txt)" in plan
    assert [r.path for r in engine.search(catalog, Request("size:>4 ext:txt")).orderBy("rank").collect()] == ["/a/b/f.txt", "/a/g.txt"]
    assert catalog.cache() is catalog and catalog.entries.count() == 6
    catalog.release()


def test_cancelling(spark):
    raised = []

    def work():
        with engine.cancellable(spark, "search"):
            try:
                spark.range(2 * 10**10).selectExpr("sum(hash(id))").collect()  # a minute or so, if nothing ends it
            except Exception as e:
                raised.append(e)

    thread = InheritableThread(target=work)
    thread.start()
    for _ in range(100):
        engine.cancel(spark, "search")
        thread.join(0.2)
        if not thread.is_alive():
            break
    assert raised and not thread.is_alive()


def test_saved_tables_can_be_discarded(spark):
    kept = storage.save(spark.range(3), "kept")
    assert kept.count() == 3 and storage.discard(spark) >= 1 and storage.discard(spark) == 0


def test_small_helpers(spark):
    df = spark.createDataFrame([("/a/b/c", "/a/b/d"), ("/a", "/x"), ("/a", "/a")], "a string, b string")
    assert [r[0] for r in df.select(schema.common_prefix(F.col("a"), F.col("b"))).collect()] == ["/a/b", "/", "/a"]
    assert [r[0] for r in spark.createDataFrame([("é",), ("e",)], "n string").select(schema.is_ascii(F.col("n"))).collect()] == [False, True]
    assert checkpoint.fingerprint({}, ["b", "a"], True) == checkpoint.fingerprint({}, ["a", "b"], True) != checkpoint.fingerprint({}, ["a"], True)
    assert highlight.reuse_key(Request("a")) == highlight.reuse_key(Request("a", offset=5))
