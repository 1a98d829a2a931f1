import os

from pyspark.sql import functions as F

from treelens.operators import frontier, hierarchy
from treelens.operators.frontier import RECURSIVE
from treelens.operators.reconcile import ScanConfig
from treelens.sources import adapters

NONE = ScanConfig(("/",), prefixes=(), names=())


def place(root, *files):
    for f in files:
        path = root / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (len(f) % 7 + 1))


def catalog(spark, root):
    """The tree as it is on disk, as entries (with the folders above it)."""
    rows = [(str(root), True)]
    for base, folders, files in os.walk(root):
        rows += [(f"{base}/{d}", True, 0, int(os.stat(f"{base}/{d}").st_mtime)) for d in folders]
        rows += [(f"{base}/{f}", False, os.stat(f"{base}/{f}").st_size, int(os.stat(f"{base}/{f}").st_mtime)) for f in files]
    return adapters.from_paths(spark, rows)


class Reader:
    """Lists directories on the executors and notes which."""

    def __init__(self):
        self.listed = []

    def __call__(self, level):
        self.listed += [r.directory for r in level.collect()]
        return adapters.read_directories(level)


def changes(spark, entries, due, read, config=NONE, root=""):
    due = spark.createDataFrame([(str(p), s) for p, s in due], "path string, scope int")
    found = frontier.reconcile(entries, hierarchy.folder_paths(entries), due, read, config)
    return sorted((r.directory.removeprefix(str(root)) + "/" + r["name"], r.change) for r in found.collect() if not (r.change == "update" and r.is_dir))


def test_known_folders_are_left_alone(spark, tmp_path):
    place(tmp_path, "a/one.txt", "a/known/deep/two.txt", "a/gone/three.txt", "a/gone/far/four.txt", "b/five.txt", "c/six.txt")
    entries = catalog(spark, tmp_path)
    place(tmp_path, "a/new/er/seven.txt", "a/known/eight.txt", "b/nine.txt", "c/ten.txt", "a/one.txt2")
    (tmp_path / "a/one.txt").write_text("longer than it was")
    os.rename(tmp_path / "a/gone", tmp_path / "elsewhere")
    read = Reader()
    found = changes(spark, entries, [(tmp_path / "a", 1)], read, root=tmp_path)
    assert found == [
        ("/a/gone", "delete"), ("/a/gone/far", "delete"), ("/a/gone/far/four.txt", "delete"), ("/a/gone/three.txt", "delete"), ("/a/new", "insert"), ("/a/new/er", "insert"), ("/a/new/er/seven.txt", "insert"), ("/a/one.txt", "update"), ("/a/one.txt2", "insert"),
    ]
    # the known folder, whose content changed too, was not listed; the new ones were
    assert sorted(p.removeprefix(str(tmp_path)) for p in read.listed) == ["/a", "/a/new", "/a/new/er"]


def test_recursive_changes_cover_and_are_listed_once(spark, tmp_path):
    place(tmp_path, "a/known/deep/two.txt", "b/five.txt")
    entries = catalog(spark, tmp_path)
    place(tmp_path, "a/known/eight.txt", "a/known/deep/nine.txt", "b/ten.txt")
    read = Reader()
    due = [(tmp_path / "a", RECURSIVE), (tmp_path / "a/known", 1), (tmp_path / "a/known/deep", RECURSIVE), (tmp_path / "a", 1)]
    assert changes(spark, entries, due, read, root=tmp_path) == [("/a/known/deep/nine.txt", "insert"), ("/a/known/eight.txt", "insert")]
    assert sorted(p.removeprefix(str(tmp_path)) for p in read.listed) == ["/a", "/a/known", "/a/known/deep"]
    assert changes(spark, entries, [], Reader()) == []


def test_excluded_roots_leave_the_catalog(spark, tmp_path):
    place(tmp_path, "a/one.txt", "skip/two.txt", "skip/in/three.txt", "a/cache-1/four.txt")
    entries = catalog(spark, tmp_path)
    config = ScanConfig((str(tmp_path),), patterns=("cache-?",), prefixes=(), names=("skip",))
    read = Reader()
    found = changes(spark, entries, [(tmp_path / "skip", RECURSIVE), (tmp_path / "a", 1)], read, config, tmp_path)
    assert found == [("/a/cache-1", "delete"), ("/a/cache-1/four.txt", "delete"), ("/skip", "delete"), ("/skip/in", "delete"), ("/skip/in/three.txt", "delete"), ("/skip/two.txt", "delete")]
    assert [p.removeprefix(str(tmp_path)) for p in read.listed] == ["/a"]


def test_what_cannot_be_read_keeps_what_it_has(spark, tmp_path):
    place(tmp_path, "a/in/one.txt", "a/two.txt")
    entries = catalog(spark, tmp_path)
    os.remove(tmp_path / "a/two.txt")

    def read(level):
        rows = adapters.read_directories(level)
        denied = F.col("directory").endswith("/in")
        return rows.where(~denied).unionByName(level.where(denied).select("directory", *[F.lit(None).alias(c) for c in ("name", "is_dir", "is_symlink", "size", "modified")], F.lit("denied").alias("failure")))

    assert changes(spark, entries, [(tmp_path / "a", RECURSIVE)], read, root=tmp_path) == [("/a/two.txt", "delete")]
