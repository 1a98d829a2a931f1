"""Changes of a catalog: every operation reads one snapshot and returns the next."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import MoveRefused
from ..schema import COLUMNS, ancestors, contains, last_component, parent_path
from ..storage import matched, save, spread
from . import hierarchy


#: Rows of a bucket, on average, that are numbered together.
BUCKET_ROWS = 200_000


def allocate_ids(new: DataFrame, used: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``id`` above every id of ``used``, one after the other without a gap.

    Rows are numbered within hash buckets of their keys and each bucket gets
    an offset, so nothing is numbered in one task but the buckets.  Their
    number follows from that of the rows (which are written first) unless it is
    given; the same rows get the same ids on every run.
    """
    if buckets is None:
        new = save(new, "new-rows")
        buckets = max(8, -(-new.count() // BUCKET_ROWS))
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = new.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offset = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    last = used.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = new.withColumn("_row", F.row_number().over(W.partitionBy("_bucket").orderBy(*keys)))
    out = numbered.join(F.broadcast(offset), "_bucket").join(F.broadcast(last))  # at most `buckets` rows, and one row
    return out.withColumn("id", F.col("_last") + F.col("_offset") + F.col("_row")).drop("_bucket", "_offset", "_row", "_last")


def upsert(entries: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """The next snapshot with ``change``: insert, update or none (for rows that incoming has no news for).

    Rows meet on (parent, name); of several incoming ones the last by ``seq``
    counts (without seq the largest by kind, size, time and id, so that reruns
    agree).  An incoming ``id`` (column, if there is one) becomes the row's id;
    a folder keeps its own, so that its children stay its children.  Without
    the column existing rows keep their ids and new rows get fresh ones.  What
    does not differ is no change.  Incoming ids must be free.
    """
    given = "id" in incoming.columns
    values = ["is_dir", "size", "modified", *(["id"] if given else [])]
    fields = F.struct(*([F.col(seq).alias("_seq")] if seq else []), *values)
    incoming = incoming.groupBy("parent", "name").agg(F.max(fields).alias("f")).select("parent", "name", *[f"f.{c}" for c in values])
    both = entries.join(incoming.select("parent", "name", *[F.col(c).alias(f"new_{c}") for c in values]), ["parent", "name"], "left")
    if given:
        both = both.withColumn("new_id", F.when(F.col("is_dir") & F.col("new_is_dir"), F.col("id")).otherwise(F.col("new_id")))
    differs = F.col("new_is_dir").isNotNull() & ~reduce(and_, [F.col(f"new_{c}").eqNullSafe(F.col(c)) for c in values])
    kept = [c for c in COLUMNS if c not in values]
    old = both.select(*kept, *[F.when(differs, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values], F.when(differs, "update").otherwise("none").alias("change"))
    added = incoming.join(entries.select("parent", "name"), ["parent", "name"], "left_anti")
    added = added if given else allocate_ids(added, entries, ["parent", "name"])
    return old.select(*COLUMNS, "change").unionByName(added.select(*COLUMNS, F.lit("insert").alias("change")))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, change`` of the rows that differ between two snapshots: insert, update or delete.

    One join on id, in which both sides are shuffled once; null values are
    equal to each other.  Ids must be unique in each snapshot.
    """
    values = [c for c in COLUMNS if c != "id"]
    old = before.select("id", F.struct(*values).alias("_old"))
    new = after.select("id", F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return old.join(new, "id", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id", change.alias("change"))


def advance(version: int, before: DataFrame, after: DataFrame) -> int:
    """The data version of ``after``: one more than that of ``before`` if any row differs, else the same (writes of what is there do not count).

    The rows' own ``change`` is believed where there is one, as after ``upsert``.
    """
    moved = after.where("change <> 'none'") if "change" in after.columns else changes(before, after)
    return version if moved.isEmpty() else version + 1


def insert(entries: DataFrame, rows: DataFrame) -> DataFrame:
    return entries.unionByName(rows.select(*COLUMNS))


def delete_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Without these rows; unknown ids are ignored, children stay as orphans."""
    return entries.join(ids.select("id").distinct(), "id", "left_anti").select(*COLUMNS)


def delete_subtree(entries: DataFrame, ids: DataFrame, keep: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Without these folders and all below them; subtrees in ``keep`` stay, with their ancestors.

    paths: the entries' folder paths, here and below, if they are known already.
    """
    paths = hierarchy.folder_paths(entries) if paths is None else paths
    gone = hierarchy.descendants(entries, paths, ids)
    if keep is not None:
        stay = hierarchy.descendants(entries, paths, keep).unionByName(hierarchy.ancestor_ids(entries, paths, keep))
        gone = gone.join(stay.distinct(), "id", "left_anti")
    return entries.join(gone, "id", "left_anti").select(*COLUMNS)


def clear(entries: DataFrame, preserve: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Nothing, or only the subtrees ``preserve`` (column id) and their ancestors."""
    if preserve is None:
        return entries.limit(0)
    paths = hierarchy.folder_paths(entries) if paths is None else paths
    stay = hierarchy.descendants(entries, paths, preserve).unionByName(hierarchy.ancestor_ids(entries, paths, preserve))
    return entries.join(stay.distinct(), "id", "left_semi").select(*COLUMNS)


def ensure_folders(entries: DataFrame, wanted: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The snapshot with every folder of ``wanted`` (column path) and their ancestors, below an index root that holds them.

    A file in a folder's place gives way to it.
    """
    paths = hierarchy.folder_paths(entries) if paths is None else paths
    known = paths.where("path is not null").select("id", "path")
    roots = entries.where("parent = 0").select(F.when(F.col("name") == "", "/").otherwise(F.col("name")).alias("holder"))
    owned = hierarchy.owner(wanted.select("path").distinct(), roots).where("owner is not null")
    each = owned.withColumn("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path")))).where(contains(F.col("owner"), F.col("path"))).select("path").distinct()
    missing = save(allocate_ids(each.join(known, "path", "left_anti"), entries, ["path"]), "missing")
    places = known.unionByName(missing.select("id", "path"))
    made = missing.withColumn("_up", parent_path(F.col("path"))).join(places.select(F.col("id").alias("parent"), F.col("path").alias("_up")), "_up")
    zero = F.lit(0).cast("long")
    made = made.select("id", "parent", last_component(F.col("path")).alias("name"), F.lit(True).alias("is_dir"), zero.alias("size"), zero.alias("modified"))
    return insert(entries.join(made.select("parent", "name"), ["parent", "name"], "left_anti").select(*COLUMNS), made)


def _at(catalog: DataFrame, path: str) -> dict:
    found = catalog.where((F.col("path") == path)).select("id", "parent", "name", "is_dir").limit(2).collect()
    if len(found) != 1:
        raise MoveRefused(f"There is no single entry at {path}.")
    return found[0].asDict()


def relocate(entries: DataFrame, source: str, target: str, replace_empty: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """The subtree at ``source`` at ``target``: one row changes.

    Refused: into itself, onto anything but an empty folder (and onto that
    only if ``replace_empty``), or below a folder that is not there.  An index
    root moves by its name, which is its whole path.
    """
    if target == source or target.startswith(source.rstrip("/") + "/"):
        raise MoveRefused("A folder cannot be moved into itself.")
    paths = hierarchy.folder_paths(entries) if paths is None else paths
    places = {source, target, target.rsplit("/", 1)[0] or "/"}
    up = F.broadcast(paths.where(F.col("path").isin(*{p.rsplit("/", 1)[0] or "/" for p in places})))  # three folders at most
    near = entries.join(up.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select(*COLUMNS).unionByName(entries.where("parent = 0").select(*COLUMNS))
    catalog = save(hierarchy.with_paths(near, up, "empty", few=True).where(F.col("path").isin(*places)), "places")
    moved = _at(catalog, source)
    there = catalog.where(F.col("path") == target).select("id", "is_dir").limit(1).collect()
    if there:
        if not (replace_empty and there[0].is_dir and entries.where(F.col("parent") == there[0].id).isEmpty()):
            raise MoveRefused(f"{target} is occupied.")
        entries = entries.where(F.col("id") != there[0].id)
    if moved["parent"] == 0:
        parent, name = 0, target
    else:
        parent, name = _at(catalog, target.rsplit("/", 1)[0] or "/")["id"], target.rsplit("/", 1)[1]
    here = F.col("id") == moved["id"]
    return entries.select("id", F.when(here, F.lit(parent)).otherwise(F.col("parent")).cast("long").alias("parent"), F.when(here, F.lit(name)).otherwise(F.col("name")).alias("name"), "is_dir", "size", "modified")


def rebuild(files: DataFrame) -> DataFrame:
    """Entries from ``id, path, is_dir, size, modified, root``: parents follow from paths, ids stay.

    root: whether the row is an index root (its name is its whole path).
    """
    files = save(files, "rebuilt")
    parents = files.where("is_dir").select(F.col("id").alias("parent"), F.col("path").alias("_up"))
    rows = matched(files.withColumn("_up", F.when(F.col("root"), F.lit(None)).otherwise(parent_path(F.col("path")))), parents, "_up")
    name = F.when(F.col("root"), F.when(F.col("path") == "/", "").otherwise(F.col("path"))).otherwise(last_component(F.col("path")))
    return rows.select("id", F.coalesce("parent", F.lit(0)).cast("long").alias("parent"), name.alias("name"), "is_dir", "size", "modified")


def _merged(rows: DataFrame, size: int) -> DataFrame:
    """One row per path of ``size`` rows: a folder beats a file, then the smaller ``side`` (the tree that stays), then the smaller id; root: whether one is."""
    best = F.min(F.struct(~F.col("is_dir"), F.col("side"), F.col("id"), F.col("is_dir").alias("dir"), F.col("size"), F.col("modified")))
    return spread(rows, size, "path").groupBy("path").agg(best.alias("b"), F.bool_or(F.col("parent") == 0).alias("root")).select("path", "b.id", F.col("b.dir").alias("is_dir"), "b.size", "b.modified", "root")


def merge_trees(entries: DataFrame, incoming: DataFrame, paths: DataFrame | None = None, incoming_paths: DataFrame | None = None) -> DataFrame:
    """Two catalogs as one: folders of equal paths merge, an incoming folder beats a file, an incoming file loses.

    Ids of ``incoming`` must differ from those of ``entries``; what lay below
    a replaced or merged folder hangs below the surviving one.  paths,
    incoming_paths: their folder paths, if they are known already.
    """
    trees = [(entries, paths), (incoming, incoming_paths)]
    sides = [hierarchy.with_paths(e, hierarchy.folder_paths(e) if p is None else p, "empty").where("path <> ''").withColumn("side", F.lit(k)) for k, (e, p) in enumerate(trees)]
    both = sides[0].unionByName(sides[1])
    # a file that lost to a folder can hold nothing; what was below a file's path cannot exist
    return rebuild(_merged(both, entries.count() + incoming.count()))


def normalise_roots(roots: list[str]) -> list[str]:
    """Absolute, without final slashes, each once, none inside another."""
    clean = sorted({r.rstrip("/") or "/" for r in roots if r.startswith("/")}, key=lambda r: (len(r), r))
    kept: list[str] = []
    for r in clean:
        if not any(r == k or k == "/" or r.startswith(k + "/") for k in kept):
            kept.append(r)
    return sorted(kept)


def sync_roots(entries: DataFrame, roots: list[str], paths: DataFrame | None = None) -> DataFrame:
    """The catalog with exactly these index roots: what they hold stays with its ids, the rest goes, missing roots are made."""
    wanted = normalise_roots(roots)
    spark = entries.sparkSession
    rows = hierarchy.with_paths(entries, hierarchy.folder_paths(entries) if paths is None else paths, "empty").where("path <> ''")
    if not wanted:
        return entries.limit(0)
    table = spark.createDataFrame([(r,) for r in wanted], "holder string")
    inside = rows.where(reduce(or_, [contains(F.lit(r), F.col("path")) for r in wanted]))
    kept = save(_merged(inside.withColumn("side", F.lit(0)), entries.count()).drop("root"), "kept")
    zero = F.lit(0).cast("long")
    missing = table.select(F.col("holder").alias("path")).join(kept.where(F.col("path").isin(*wanted)).select("path"), "path", "left_anti")
    made = allocate_ids(missing, entries, ["path"]).select("path", "id", F.lit(True).alias("is_dir"), zero.alias("size"), zero.alias("modified"))
    files = kept.unionByName(made)
    return rebuild(files.withColumn("root", F.col("path").isin(*wanted)))
