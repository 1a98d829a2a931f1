"""The tree: paths of folders, subtrees, owners and covers.

A folder's path comes from its chain of parents by pointer doubling: each
round every folder jumps twice as far and joins the names on the way, so a
tree of depth d takes log2(d) joins of the folders with themselves.  After
some jumps very many folders wait for the few at the top; those are broadcast.
Files never take part; their path is one join away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleFound
from ..schema import contains, cut, depth, folder_above, join_path
from ..storage import HEAVY_ROWS, drop, matched, save

#: Jumps of 2**MAX_ROUNDS levels; a chain that is still open then is a cycle.
MAX_ROUNDS = 12


def folders(entries: DataFrame) -> DataFrame:
    return entries.where("is_dir or parent = 0")


def folder_paths(entries: DataFrame) -> DataFrame:
    """``id, path, chain`` of every folder; chain: ids from the index root to the folder.

    The filesystem root (empty name) has path /.  Folders whose chain breaks
    off (orphans and all below them) have a null path and a null chain.
    """
    first = folders(entries).select("id", F.col("parent").alias("up"), F.col("name").alias("tail"), F.array("id").alias("chain"))
    rounds = [save(first, "paths")]
    done, open_ = [rounds[0].where("up <= 0")], rounds[0].where("up > 0")
    for _ in range(MAX_ROUNDS + 1):
        # each round is written: the next one reads it, and its plan does not hold those before
        if open_.isEmpty():
            break
        known = open_
        for part in done:
            known = known.unionByName(part)
        other = known.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("tail").alias("head"), F.col("chain").alias("before"))
        joined = matched(open_, other, "up").select("id", F.coalesce("up2", F.lit(-1)).alias("up"), F.concat_ws("/", "head", "tail").alias("tail"), F.concat("before", "chain").alias("chain"))
        rounds.append(save(joined, "paths"))
        done.append(rounds[-1].where("up <= 0"))
        open_ = rounds[-1].where("up > 0")
    else:
        raise CycleFound("the parents of a folder form a cycle")
    state = reduce(DataFrame.unionByName, done)
    path = F.when(F.col("tail") == "", "/").otherwise(F.col("tail"))
    paths = save(state.select("id", F.when(F.col("up") == 0, path).alias("path"), F.when(F.col("up") == 0, F.col("chain")).alias("chain")), "paths")
    drop(*rounds)
    return paths


def full_path(folder: Column, name: Column, parent: Column) -> Column:
    """Path of a row from its folder's; index roots carry theirs as their name."""
    return F.when(parent == 0, F.when(name == "", "/").otherwise(name)).otherwise(join_path(folder, name))


def with_paths(rows: DataFrame, paths: DataFrame, orphan_path: str = "name", few: bool = False, how: str = "left") -> DataFrame:
    """Adds ``path``.  orphan_path: ``name`` for results, ``empty`` for predicates.

    few: rows or paths are a page's, and are joined as they are.  how: inner
    leaves out rows whose folder is not in paths.
    """
    folders_ = paths.select(F.col("id").alias("parent"), F.col("path").alias("_path"))
    found = (rows.join(folders_, "parent", how) if few else matched(rows, folders_, "parent", how)).select(*rows.columns, "_path")
    fallback = F.col("name") if orphan_path == "name" else F.lit("")
    return found.withColumn("path", F.coalesce(full_path(F.col("_path"), F.col("name"), F.col("parent")), fallback)).drop("_path")


def descendants(entries: DataFrame, paths: DataFrame, ids: DataFrame, include_self: bool = True) -> DataFrame:
    """Ids of all rows below the folders ``ids`` (column id), and of themselves."""
    marks = save(ids.select(F.col("id").alias("mark")).distinct(), "marks")
    # only folders hold anything; all folders lie below the few at the top
    tops = save(matched(marks, paths.select(F.col("id").alias("mark")), "mark", "inner"), "marks")
    above = paths.where("chain is not null").select("id", F.explode("chain").alias("mark"))
    above = above.join(F.broadcast(tops), "mark", "left_semi") if tops.count() <= HEAVY_ROWS else matched(above, tops, "mark", "inner")
    inside = save(above.select(F.col("id").alias("parent")).distinct(), "inside")
    below = matched(entries.select("id", "parent"), inside, "parent", "inner").select("id")
    own = entries.join(marks, F.col("id") == F.col("mark"), "left_semi").select("id")
    return below.unionByName(own).distinct() if include_self else below.join(marks, F.col("id") == F.col("mark"), "left_anti")


def ancestor_ids(entries: DataFrame, paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of all folders above the rows ``ids``, without themselves."""
    rows = entries.join(ids.select("id").distinct(), "id", "left_semi").select("parent")
    return rows.join(paths.select(F.col("id").alias("parent"), "chain"), "parent").select(F.explode("chain").alias("id")).distinct()


def lookup(entries: DataFrame, paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at the paths ``wanted`` (column path): path joined by equality."""
    return with_paths(entries, paths, "empty").join(wanted.select("path").distinct(), "path")


def child(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the (parent, name) pairs in ``wanted``."""
    return entries.join(wanted.select("parent", "name").distinct(), ["parent", "name"])


def children(entries: DataFrame, parent: int) -> DataFrame:
    return entries.where(F.col("parent") == parent)


def fetch(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def child_folders(entries: DataFrame, parent: int) -> DataFrame:
    return entries.where((F.col("parent") == parent) & F.col("is_dir"))


def nearest(asked: DataFrame, holders: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (column path) with the deepest holder (column owner, each once) at or above them, and its other columns.

    how: inner, or left for rows without a holder too.

    A path is cut to the depth of the deepest holder first; then all paths of
    a folder ask for that folder once, level by level, only as far up as
    nothing was found.  No path is multiplied by its ancestors.
    """
    deepest = holders.agg(F.coalesce(F.max(depth(F.col("owner"))), F.lit(0))).first()[0]
    rows = asked.withColumn("_at", cut(F.col("path"), deepest))
    known = holders.withColumn("_at", F.col("owner"))
    level, levels = save(rows.where("_at is not null").select("_at").distinct(), "asked"), []
    while not level.isEmpty():
        met = save(matched(level, known, "_at"), "asked")
        rest = met.where("owner is null").select("_at", folder_above(F.col("_at")).alias("_up")).where("_up is not null")
        levels.append((met.where("owner is not null"), rest))
        level = save(rest.select(F.col("_up").alias("_at")).distinct(), "asked")
    found = known.limit(0)
    for met, rest in reversed(levels):
        lower = matched(rest, found.withColumnRenamed("_at", "_up"), "_up", "inner").drop("_up")
        found = save(met.unionByName(lower), "answers")
    return matched(rows, found, "_at", how).drop("_at")


def owner(paths: DataFrame, holders: DataFrame, longest: bool = True) -> DataFrame:
    """``path`` -> ``path, owner``: the longest (or shortest) holder (column holder) that contains it; null if none does."""
    own = holders.select(F.col("holder").alias("owner")).where("owner is not null").distinct()
    if not longest:
        own = minimal_cover(own.withColumnRenamed("owner", "path")).withColumnRenamed("path", "owner")
    return nearest(paths, save(own, "holders"), "left").select("path", *[c for c in paths.columns if c != "path"], "owner")


def deepest_known(entries: DataFrame, paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path`` -> ``path, id, owner``: the deepest folder of the catalog at or above it (of several at one path that with the least id)."""
    known = save(paths.where("path is not null").groupBy(F.col("path").alias("owner")).agg(F.min("id").alias("id")), "known")
    return nearest(save(wanted.select("path").distinct(), "wanted"), known).select("path", "id", "owner")


def minimal_cover(paths: DataFrame) -> DataFrame:
    """The paths that no other of them contains."""
    distinct = save(paths.select("path").distinct(), "cover")
    up = distinct.select(F.col("path").alias("_of"), folder_above(F.col("path")).alias("path"))
    return nearest(up, distinct.withColumnRenamed("path", "owner"), "left").where("owner is null").select(F.col("_of").alias("path"))


__all__ = ["ancestor_ids", "child", "child_folders", "children", "contains", "deepest_known", "descendants", "fetch", "folder_paths", "folders", "lookup", "minimal_cover", "nearest", "owner", "with_paths"]
