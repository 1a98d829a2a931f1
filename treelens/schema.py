"""The catalog's one table and the expressions over a single row of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("parent", T.LongType(), False),  # 0: an index root, whose name is its whole path
    T.StructField("name", T.StringType(), False),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("modified", T.LongType(), False),  # epoch seconds
])
COLUMNS = ENTRIES.fieldNames()

EVENTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("flags", T.LongType()), T.StructField("ts", T.TimestampType())])


def extension(name: Column) -> Column:
    """What follows the last dot, if something precedes that dot; else empty."""
    return F.regexp_extract(name, r"(?s)^.*[^/]\.([^./]+)$", 1)


#: Columns that searches look at besides the entries' own.
SEARCHED = ("folded", "ext")


def searchable(entries: DataFrame) -> DataFrame:
    """The entries with their names and extensions in lower case."""
    return entries.select(*COLUMNS, F.lower("name").alias("folded"), F.lower(extension(F.col("name"))).alias("ext"))


def kind(name: Column, is_dir: Column) -> Column:
    ext = extension(name)
    return F.when(is_dir, "Folder").when(ext == "", "File").otherwise(F.concat(F.upper(ext), F.lit(" File")))


def name_bytes(name: Column) -> Column:
    return F.octet_length(name)


def is_ascii(name: Column) -> Column:
    return F.octet_length(name) == F.length(name)


def last_component(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """The path without its last component; / stays /."""
    before = F.length(path) - F.length(F.substring_index(path, "/", -1))  # characters up to the last slash, and with it
    return F.when((path == "") | (before == 1), "/").when(before == 0, path).otherwise(F.substring(path, F.lit(1), before - 1))


def join_path(parent: Column, name: Column) -> Column:
    return F.concat(F.when(parent == "/", "").otherwise(parent), F.lit("/"), name)


def normalised(path: Column) -> Column:
    """Without slashes at the end; / stays /."""
    cut = F.regexp_replace(path, "/+$", "")
    return F.when((cut == "") & (F.length(path) > 0), "/").otherwise(cut)


def contains(parent: Column, child: Column) -> Column:
    """Whether child is parent or lies below it, by whole components."""
    return (child == parent) | (parent == "/") & child.startswith("/") | child.startswith(F.concat(parent, F.lit("/")))


def ancestors(path: Column) -> Column:
    """/a/b/c -> [/, /a, /a/b]; the path itself is not among them."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("/")), F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<string>"))))


def _usual(path: Column) -> Column:
    """Whether a path is written as the catalog writes it: no list of its parts is needed then."""
    return path.startswith("/") & ~path.contains("//") & ~path.endswith("/")


def depth(path: Column) -> Column:
    """The number of folders above a path, 0 for /."""
    return F.when(_usual(path), F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).otherwise(F.size(ancestors(path)))


def cut(path: Column, levels: int) -> Column:
    """The folder above a path (or itself) that has ``levels`` folders above it; the path where it has no more than that."""
    first = F.substring_index(path, "/", levels + 1)
    up = ancestors(path)
    return F.when(_usual(path), F.when(first == "", "/").otherwise(first)).otherwise(F.when(F.size(up) > levels, F.get(up, F.lit(levels))).otherwise(path))


def folder_above(path: Column) -> Column:
    """The last of ``ancestors``; null for /."""
    first = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    up = ancestors(path)
    return F.when(_usual(path), F.when(first == "", "/").otherwise(first)).otherwise(F.get(up, F.size(up) - 1))


def common_prefix(a: Column, b: Column) -> Column:
    """The deepest folder that holds both paths."""
    left, right = F.filter(F.split(a, "/"), lambda p: p != ""), F.filter(F.split(b, "/"), lambda p: p != "")
    same = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    stop = F.array_position(same, F.lit(False))
    count = F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")
    return F.concat(F.lit("/"), F.array_join(F.slice(left, F.lit(1), F.greatest(count, F.lit(0))), "/"))


def share_identity(url: Column, filesystem: Column) -> Column:
    """share:<file system>:<host[:port]>/<path>; the host lower-cased, credentials dropped."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, "^([^/]*)", 1))
    return F.concat(F.lit("share:"), filesystem, F.lit(":"), host, F.regexp_replace(F.regexp_extract(rest, "^[^/]*(/.*)?$", 1), "/+$", ""))
