"""Joins that hold in small tasks: heavy keys, odd paths, depth of holders."""

import time

import pytest
from pyspark.sql import functions as F

from treelens import schema, storage
from treelens.operators import hierarchy, reconcile
from treelens.sources import adapters

ODD = ["/", "/a", "/a/b", "/a/b/c", "//a", "/a//b", "/a/", "a/b", "a", "", "//", None]


def test_cut_and_depth_agree_with_the_list_of_ancestors(spark):
    rows = spark.createDataFrame([(p,) for p in ODD], "path string")
    path, up = F.col("path"), schema.ancestors(F.col("path"))
    for levels in range(4):
        plain = F.when(F.size(up) > levels, F.get(up, F.lit(levels))).otherwise(path)
        assert rows.where(~schema.cut(path, levels).eqNullSafe(plain)).collect() == []
    assert rows.where(~schema.folder_above(path).eqNullSafe(F.get(up, F.size(up) - 1))).collect() == []
    assert rows.where(~schema.depth(path).eqNullSafe(F.size(up))).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_matched_with_heavy_keys_is_the_join(spark, monkeypatch, how):
    monkeypatch.setattr(storage, "HEAVY_ROWS", 20)
    monkeypatch.setattr(storage, "TASK_ROWS", 30)
    left = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id")
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = storage.matched(left, right, "k", how)
    assert sorted(joined.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
    # failed before: one task got all rows of a key, whatever their number
    sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 400


def test_paths_when_all_folders_wait_for_few(spark, monkeypatch):
    entries = adapters.from_paths(spark, [(f"/r{i % 2}/n{i % 4}/c{i}/o{i}", True) for i in range(80)])
    plain = {tuple(r) for r in hierarchy.folder_paths(entries).select("id", "path").collect()}
    monkeypatch.setattr(storage, "HEAVY_ROWS", 5)
    monkeypatch.setattr(storage, "TASK_ROWS", 10)
    assert {tuple(r) for r in hierarchy.folder_paths(entries).select("id", "path").collect()} == plain
    assert len(plain) == 1 + 2 + 4 + 80 + 80


def test_deepest_known_never_multiplies_paths(spark):
    entries = adapters.from_paths(spark, [("/a/b", True), ("/c", True)])
    wanted = spark.createDataFrame([("/a/b/x/y/z",), ("/a/b",), ("/a/q",), ("/d/e",), ("/",)], "path string")
    found = hierarchy.deepest_known(entries, hierarchy.folder_paths(entries), wanted)
    assert {(r.path, r.owner) for r in found.collect()} == {("/a/b/x/y/z", "/a/b"), ("/a/b", "/a/b"), ("/a/q", "/a"), ("/d/e", "/"), ("/", "/")}
    # failed before: each path was exploded to all folders above it
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


ITEMS = "path string, is_dir boolean, size long, modified long"


def test_the_folder_of_a_path_is_what_the_pattern_leaves(spark):
    rows = spark.createDataFrame([(p,) for p in [*ODD, "/a/b\n", "\n/", "/a\n/b", "/\u00e9/\u00fc"]], "path string")
    left = F.regexp_replace("path", "/[^/]*$", "")
    assert rows.where(~schema.parent_path(F.col("path")).eqNullSafe(F.when(left == "", "/").otherwise(left))).collect() == []


def test_point_check_gives_a_row_for_each_stored_row(spark):
    stored = spark.createDataFrame([("/a/d", True, 0, 0)] * 5 + [("/a/f", False, 1, 1), ("/a/f", False, 2, 1)], ITEMS)
    observed = spark.createDataFrame([("/a/d", True, 0, 0)] * 5 + [("/a/f", False, 2, 1)] + [("/a/n", False, 1, 1)] * 3, ITEMS)
    folders = spark.createDataFrame([("/a",), ("/a",), ("/",)], "path string")
    changed = stored.select("path").unionByName(observed.select("path"))
    out = reconcile.point_check(changed, stored, observed, folders)
    # failed before: 25 rows of /a/d and 3 of /a/n, so n * n rows where n catalogs hold one path
    assert sorted(map(tuple, out.collect())) == [("/a/d", "directory")] * 5 + [("/a/f", "none"), ("/a/f", "update"), ("/a/n", "insert")]


@pytest.mark.parametrize(("heavy", "slices"), [(10**6, 30), (10, 10**9), (10, 30)])
def test_point_check_in_slices_and_with_heavy_folders(spark, monkeypatch, heavy, slices):
    stored = spark.createDataFrame([(f"/d{i % 3}/f{i}", i % 9 == 0, i % 4, 1) for i in range(60)] + [("/", True, 0, 0), ("f", False, 1, 1)], ITEMS)
    observed = spark.createDataFrame([(f"/d{i % 4}/f{i}", i % 12 == 0, i % 4 + i % 2, 1) for i in range(80)] + [(f"/e{i}/f", False, 0, 0) for i in range(20)] + [("f", False, 1, 2)], ITEMS)
    folders = spark.createDataFrame([("/",), ("/d0",), ("/d1",), ("/d2",), ("/e3",)], "path string")
    changed = stored.select("path").unionByName(observed.select("path")).unionByName(spark.createDataFrame([("/d1/never",), (None,)], "path string"))
    plain = sorted(map(tuple, reconcile.point_check(changed, stored, observed, folders).collect()), key=str)
    assert {a for _, a in plain} == {"none", "update", "delete", "insert", "directory", "parent"} and len(plain) == len({p for p, _ in plain})
    monkeypatch.setattr(reconcile, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(reconcile, "SLICE_ROWS", slices)
    assert sorted(map(tuple, reconcile.point_check(changed, stored, observed, folders).collect()), key=str) == plain


def test_point_check_shuffles_each_side_once(spark):
    side = spark.range(1000).select(F.concat(F.lit("/d/f"), "id").alias("path"), F.lit(False).alias("is_dir"), F.lit(1).alias("size"), F.lit(1).alias("modified"))
    out = reconcile.point_check(side.select("path"), side, side, spark.createDataFrame([("/d",)], "path string"))
    # one for all rows and one for the folders: a third would deal all rows again to meet their folders
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f.rsplit("/", 1)[-1] for f in files if "/shuffle_" in f}


def test_saving_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, setting = _shuffles(spark), spark.conf.get(key)
    storage.save(spark.range(10000).repartition(3, "id"), "dealt")
    end = time.time() + 10
    while _shuffles(spark) - old and time.time() < end:
        time.sleep(0.1)
    # failed before: they stayed until the driver's garbage was collected
    assert not _shuffles(spark) - old and spark.conf.get(key) == setting


def test_folder_paths_keep_one_table(spark):
    entries = adapters.from_paths(spark, [("/a/b/c/d/e/f", True)])
    before = len(spark.__dict__.get("_treelens_folders", []))
    found = hierarchy.folder_paths(entries)
    # failed before: a table for each round stayed
    assert len(spark._treelens_folders) == before + 1 and found.where("path = '/a/b/c/d/e/f'").count() == 1
