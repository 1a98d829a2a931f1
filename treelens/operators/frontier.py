"""Reconciling only what is due: folders are listed level by level, and a walk goes no deeper than it has to.

A recursive change lists its whole subtree.  A change of one folder lists that
folder, and below it only folders that the catalog does not know yet; known
ones are left as they are.  Changes inside recursive ones are not walked twice,
excluded roots are not walked at all but leave the catalog.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ancestors, join_path, parent_path
from ..storage import matched, save, spread
from .hierarchy import nearest, with_paths
from .reconcile import ScanConfig, excluded_path, filter_listing

#: Scope of a change that lists a whole subtree (others list one folder).
RECURSIVE = 2


def due_roots(due: DataFrame, config: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """(``directory, recursive`` to begin with, ``path`` of excluded roots) of the changes ``path, scope``: nothing inside a recursive one."""
    rows = due.groupBy("path").agg(F.max((F.col("scope") == RECURSIVE).cast("int")).alias("deep"))
    excluded = excluded_path(F.col("path"), config)
    walked = rows.where(~excluded)
    deep = walked.where("deep = 1").select(F.col("path").alias("_up"))
    covered = walked.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).join(deep, "_up", "left_semi").select("path").distinct()
    return walked.join(covered, "path", "left_anti").select(F.col("path").alias("directory"), (F.col("deep") == 1).alias("recursive")), rows.where(excluded).select("path")


def walk(roots: DataFrame, paths: DataFrame, read: Callable[[DataFrame], DataFrame], config: ScanConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``directory`` that were listed whole, what they hold as the filtered listing, ``directory, failure`` of the others).

    ``read`` lists directories (column directory) and returns rows as
    ``adapters.LISTING``; it is called once for each level.  Each level is
    written, so no level is listed twice, and only its new or recursive folders
    go on to the next.
    """
    known = paths.where("path is not null").select(F.col("path").alias("directory"))
    level, listed, held, failed = save(roots.select("directory", "recursive"), "level"), [], [], []
    while True:
        rows = save(read(level.select("directory")), "listed")
        failures = rows.where("failure is not null").select("directory", "failure").distinct()
        whole = level.join(failures, "directory", "left_anti")
        items = save(filter_listing(rows.where("failure is null"), config).join(whole, "directory"), "items")
        listed.append(whole.select("directory"))
        held.append(items.drop("recursive"))
        failed.append(failures)
        below = items.where("is_dir").select(F.col("path").alias("directory"), "recursive")
        # below a new folder all is new
        fresh = below.where("not recursive").join(known, "directory", "left_anti").select("directory", F.lit(True).alias("recursive"))
        below = below.where("recursive").unionByName(fresh)
        seen = reduce(DataFrame.unionByName, listed)
        level = save(below.groupBy("directory").agg(F.max("recursive").alias("recursive")).join(seen, "directory", "left_anti"), "level")
        if level.isEmpty():
            union = lambda parts: reduce(DataFrame.unionByName, parts)
            return union(listed), union(held), union(failed)


def reconcile(entries: DataFrame, paths: DataFrame, due: DataFrame, read: Callable[[DataFrame], DataFrame], config: ScanConfig) -> DataFrame:
    """``directory, name, change`` with old and new values of all that differs in what was listed: insert, update or delete.

    entries, paths: the catalog and its folders' paths; due: ``path, scope``.
    What was not listed is not compared.  A folder that is gone, or has become
    a file, is one delete (or update) of its own row, and all rows below it are
    deletes; so is what lies at or below an excluded root.  A directory whose
    read failed keeps all it has.
    """
    roots, excluded = due_roots(due, config)
    listed, observed, failed = walk(roots, paths, read, config)
    listed, failed = save(listed, "listed"), save(failed.select("directory"), "failed")
    size = entries.count()
    stored = with_paths(entries.where("parent > 0"), paths, "empty").where("path <> ''").select("id", "path", "name", "is_dir", "size", "modified", parent_path(F.col("path")).alias("directory"))
    stored = save(stored, "stored")
    here = matched(stored, listed.distinct(), "directory", "inner").select(*stored.columns)
    new = observed.select("directory", "name", *[F.col(c).alias(f"new_{c}") for c in ("is_dir", "size")], F.col("modified").cast("long").alias("new_modified"))
    both = spread(here, size, "directory", "name").join(spread(new, size, "directory", "name"), ["directory", "name"], "full_outer")
    same = (F.col("is_dir") == F.col("new_is_dir")) & (F.col("is_dir") | (F.col("size") == F.col("new_size"))) & (F.col("modified") == F.col("new_modified"))
    change = F.when(F.col("id").isNull(), "insert").when(F.col("new_is_dir").isNull(), "delete").when(~same, "update")
    found = both.withColumn("change", change).where("change is not null").select("directory", "name", "id", "change", "is_dir", "size", "modified", "new_is_dir", "new_size", "new_modified")
    found = save(found, "found")
    # subtrees of folders that went, and excluded roots themselves; never what could not be read, or what was listed as gone above
    tops = found.where("is_dir and (change = 'delete' or not new_is_dir)").select(join_path(F.col("directory"), F.col("name")).alias("top"))
    held = failed.select("directory", F.explode(F.concat(ancestors(F.col("directory")), F.array("directory"))).alias("top")).select("top").distinct()
    tops = tops.join(held, "top", "left_anti")
    tops = save(tops.select(F.col("top").alias("owner")).distinct(), "tops")
    outside = save(excluded.select(F.col("path").alias("owner")).distinct(), "excluded")
    below = save(nearest(stored.select("id", F.col("directory").alias("path")), tops).select("id").unionByName(nearest(stored.select("id", "path"), outside).select("id")).distinct(), "below")
    gone = matched(stored, below, "id", "inner").select(*stored.columns).join(found.where("id is not null").select("id"), "id", "left_anti")
    return found.unionByName(gone.select("directory", "name", "id", F.lit("delete").alias("change"), "is_dir", "size", "modified"), allowMissingColumns=True)


