"""Stored state against an observed listing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lang.compile import glob
from ..schema import COLUMNS, ancestors, contains, parent_path
from ..storage import HEAVY_ROWS, released, save, spread, tasks
from . import hierarchy
from .mutate import allocate_ids

#: Rows of a point check's sides that are shuffled at once.
SLICE_ROWS = 150_000_000

# What a scan leaves out unless it is told otherwise.
SKIP_PREFIXES = ("/dev", "/System/Volumes", "/private/tmp", "/private/var/folders", "/.Spotlight-V100", "/.DocumentRevisions-V100", "/.Trashes", "/.fseventsd")
SKIP_NAMES = (".Spotlight-V100", ".DocumentRevisions-V100", ".fseventsd", ".TemporaryItems", ".Trash")


@dataclass(frozen=True)
class ScanConfig:
    roots: tuple[str, ...] = ("/",)
    exclusions: tuple[str, ...] = ()  # fragments of names, whatever their case
    patterns: tuple[str, ...] = ()  # wildcards for whole names, whatever their case
    prefixes: tuple[str, ...] = SKIP_PREFIXES
    names: tuple[str, ...] = SKIP_NAMES  # folders
    explicit_prefixes: tuple[str, ...] = ()

    def effective_prefixes(self) -> tuple[str, ...]:
        """A default prefix does not apply where a root lies inside it; explicit ones always do."""

        def inside(root: str, prefix: str) -> bool:
            return root == prefix or root.startswith(prefix + "/")

        return self.explicit_prefixes + tuple(p for p in self.prefixes if not any(inside(r, p) for r in self.roots))


def excluded_name(name: Column, is_dir: Column, config: ScanConfig) -> Column:
    found = F.lit(False)
    if config.names:
        found = found | (is_dir & name.isin(*config.names))
    for fragment in config.exclusions:
        found = found | F.lower(name).contains(fragment.lower())
    for pattern in config.patterns:
        found = found | name.rlike("(?ius)" + glob(pattern, "."))
    return found


def excluded_path(path: Column, config: ScanConfig) -> Column:
    """By prefix, or by any component's name (components before the last are folders)."""
    found = F.lit(False)
    for prefix in config.effective_prefixes():
        found = found | contains(F.lit(prefix), path)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return found | F.exists(parts, lambda p: excluded_name(p, F.lit(True), config))


def filter_listing(listing: DataFrame, config: ScanConfig) -> DataFrame:
    """Observed items that a scan with this config would store; links count as files and are never walked into."""
    path = F.concat(F.when(F.col("directory") == "/", "").otherwise(F.col("directory")), F.lit("/"), F.col("name"))
    rows = listing.withColumn("path", path).withColumn("is_dir", F.col("is_dir") & ~F.coalesce("is_symlink", F.lit(False)) if "is_symlink" in listing.columns else F.col("is_dir"))
    return rows.where(~excluded_path(F.col("path"), config) & ~excluded_name(F.col("name"), F.col("is_dir"), config))


def diff(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """``parent, name, change`` with old and new values: insert, update, delete or unchanged.

    Both sides have parent, name, is_dir, size, modified (observed: fractions
    of a second are cut off).  Folders compare by kind only in size.
    """
    new = observed.select("parent", "name", *[F.col(c).alias(f"new_{c}") for c in ("is_dir", "size")], F.col("modified").cast("long").alias("new_modified"))
    rows = stored.count()
    both = spread(stored, rows, "parent", "name").join(spread(new, rows, "parent", "name"), ["parent", "name"], "full_outer")
    same = (F.col("is_dir") == F.col("new_is_dir")) & (F.col("size") == F.col("new_size")) & (F.col("modified") == F.col("new_modified"))
    change = F.when(F.col("id").isNull(), "insert").when(F.col("new_is_dir").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return both.withColumn("change", change)


def apply_diff(stored: DataFrame, difference: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The snapshot after a diff: ids of changed rows stay; what lay below a folder that went, or became a file, goes too."""
    difference = save(difference.where("change <> 'unchanged'"), "difference")
    gone = difference.where("change = 'delete' or (change = 'update' and is_dir and not new_is_dir)").select("id")
    paths = hierarchy.folder_paths(stored) if paths is None else paths
    below = hierarchy.descendants(stored, paths, gone, include_self=False).unionByName(difference.where("change = 'delete'").select("id")).distinct()
    changed = difference.where("change = 'update'").select("id", "new_is_dir", "new_size", "new_modified")
    size = stored.count()
    rows = spread(stored, size, "id").join(spread(below, size, "id"), "id", "left_anti").join(spread(changed, size, "id"), "id", "left")
    kept = rows.select("id", "parent", "name", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("is_dir", "size", "modified")])
    added = difference.where("change = 'insert'").select("parent", "name", *[F.col(f"new_{c}").alias(c) for c in ("is_dir", "size", "modified")])
    return kept.unionByName(allocate_ids(added, stored, ["parent", "name"]).select(*COLUMNS))


def point_check(changed: DataFrame, stored: DataFrame, observed: DataFrame, folders: DataFrame) -> DataFrame:
    """``path, action`` for paths (column path) of which a file event came: what to do without reading their folder.

    stored and observed: ``path, is_dir, size, modified``; folders: ``path`` of
    the catalog's folders.  insert, update, delete or none for files; what is
    or was a folder needs a ``directory`` scan, and what has no known folder
    above it a scan of its ``parent``.  A path has a row for each stored row
    (two roots may hold it), else one; one thing is found at a path, of several
    the greatest counts.

    All rows of a folder go to one task, which has the folder's own row too;
    those of folders with very many are dealt by path, and their folders are
    broadcast.  Slices of SLICE_ROWS rows are done one by one, so that the
    shuffle files of one slice at most are on disk; all sides are read once for each.
    """
    spark = changed.sparkSession
    up, sides = parent_path(F.col("path")), (changed, stored.where("path is not null"), observed.where("path is not null"))
    weights = reduce(DataFrame.unionByName, [s.select(F.hash(up).alias("lot")) for s in sides]).groupBy("lot").agg(F.count("*").alias("n"))
    with released(spark):
        load = weights.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.collect_list(F.when(F.col("n") > HEAVY_ROWS, F.col("lot"))).alias("heavy")).first()
    heavy = F.hash(up).isin(load.heavy)
    lot = F.when(heavy, F.hash("path")).otherwise(F.hash(up)).alias("lot")
    asked = sides[0].select("path")
    if load.heavy:
        # one path may have very many events
        asked = asked.where(~heavy).unionByName(asked.where(heavy).distinct())
    old = sides[1].select(lot, "path", F.lit(0).alias("side"), *[F.col(c).alias(f"old_{c}") for c in ("is_dir", "size", "modified")])
    new = sides[2].select(lot, "path", F.lit(2).alias("side"), F.struct("is_dir", "size", F.col("modified").cast("long").alias("modified")).alias("new"))
    rows = old.unionByName(asked.select(lot, "path", F.lit(1).alias("side")), allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    known = folders.where("path is not null").select(F.hash("path").alias("_lot"), F.col("path").alias("_up"))
    many = known.where(F.col("_lot").isin(load.heavy)).select("_up").distinct().withColumn("_many", F.lit(True))
    slices = max(1, -(-load.rows // SLICE_ROWS))
    count = tasks(spark, -(-load.rows // slices // 2))
    parts = []
    for n in range(slices):
        mine = rows if slices == 1 else rows.where(F.pmod(F.hash("path"), F.lit(slices)) == n)
        # stored rows come first, then events: the first event stands for a path that is not stored
        ordered = W.partitionBy("lot", "path").orderBy("side")
        whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        mine = mine.repartition(count, "lot").select("*", F.row_number().over(ordered).alias("_n"), F.bool_or(F.col("side") == 1).over(whole).alias("_asked"), F.max("new").over(whole).alias("_new"))
        mine = mine.where("_asked and (side = 0 or (side = 1 and _n = 1))").select("lot", "path", "old_is_dir", "old_size", "old_modified", "_new.*", up.alias("_of"))
        # a join by lot alone finds both sides where they are; several folders may have one lot
        holders = known.repartition(count, "_lot").groupBy("_lot").agg(F.collect_set("_up").alias("_ups"))
        mine = mine.join(holders, F.col("lot") == F.col("_lot"), "left").withColumn("_known", F.coalesce(F.array_contains("_ups", F.col("_of")), F.lit(False)))
        if load.heavy:
            mine = mine.join(F.broadcast(many), F.col("_of") == F.col("_up"), "left").withColumn("_known", F.col("_known") | F.col("_many").isNotNull())
        same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
        action = (
            F.when(F.coalesce("old_is_dir", F.lit(False)) | F.coalesce("is_dir", F.lit(False)), "directory")
            .when(F.col("is_dir").isNull(), F.when(F.col("old_is_dir").isNull(), "none").otherwise("delete"))
            .when(~F.col("_known"), "parent")
            .when(F.col("old_is_dir").isNull(), "insert")
            .otherwise(F.when(same, "none").otherwise("update"))
        )
        part = mine.select("path", action.alias("action"))
        parts.append(part if slices == 1 else save(part, "checked", compression="zstd"))
    return reduce(DataFrame.unionByName, parts)


def counters(difference: DataFrame) -> DataFrame:
    """One row: scanned, written, deleted, dirs, files, changed."""
    written = F.col("change").isin("insert", "update")
    return difference.agg(
        F.count_if(F.col("change") != "delete").alias("scanned"), F.count_if(written).alias("written"), F.count_if(F.col("change") == "delete").alias("deleted"),
        F.count_if(F.col("new_is_dir")).alias("dirs"), F.count_if(~F.col("new_is_dir")).alias("files"), F.coalesce(F.bool_or(F.col("change") != "unchanged"), F.lit(False)).alias("changed"),
    )


def guarded_deletes(deletes: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Deletes (column path) without those at, below or above an unavailable place (column path)."""
    held = unavailable.select(F.col("path").alias("holder"))
    safe = hierarchy.owner(deletes, held).where("owner is null").drop("owner")
    above = unavailable.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return safe.join(above, "path", "left_anti")


def resolve_failed_reads(stored: DataFrame, failed: DataFrame) -> DataFrame:
    """Folders (column id) whose read failed, by ``reason``: delete if missing, keep if denied, else error."""
    return stored.join(failed, "id").select("id", F.when(F.col("reason") == "missing", "delete").when(F.col("reason") == "denied", "keep").otherwise("error").alias("action"))
