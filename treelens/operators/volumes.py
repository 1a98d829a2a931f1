"""Volumes and locations: which mount a root lies on, and where a known volume is now."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import share_identity
from . import hierarchy


@dataclass(frozen=True)
class Mount:
    path: str
    identity: str


@dataclass(frozen=True)
class Binding:
    """A configured path and the volume it was on when it was last seen."""

    path: str
    identity: str
    relative: str = ""  # below the volume's mount point


@dataclass(frozen=True)
class Resolution:
    available: tuple[str, ...]
    unavailable: tuple[str, ...]
    moves: dict[str, str]


def _inside(parent: str, child: str) -> bool:
    return child == parent or parent == "/" or child.startswith(parent + "/")


def volume_of(path: str, mounts: list[Mount]) -> Mount | None:
    return max((m for m in mounts if _inside(m.path, path)), key=lambda m: len(m.path), default=None)


def volumes_for(roots: list[str], mounts: list[Mount], excluded=lambda path: False) -> list[str]:
    """Mounts that the roots reach: those they lie on and those below them, without excluded ones."""
    found = {m.path for r in roots if (m := volume_of(r, mounts))}
    found |= {m.path for m in mounts for r in roots if _inside(r, m.path) and not excluded(m.path)}
    return sorted(found)


def selected(roots: DataFrame, mounts: DataFrame) -> DataFrame:
    """``path`` of the mounts (column path) that roots (column path) reach, as DataFrames."""
    on = hierarchy.owner(roots, mounts.select(F.col("path").alias("holder"))).where("owner is not null").select(F.col("owner").alias("path"))
    below = hierarchy.owner(mounts.select("path"), roots.select(F.col("path").alias("holder"))).where("owner is not null").select("path")
    return on.unionByName(below).distinct()


def resolve(bindings: list[Binding], mounts: list[Mount], exists=lambda path: True) -> Resolution:
    """Where each binding's volume is mounted now.

    Unavailable: the identity is mounted nowhere or more than once, or the
    folder is missing on it, or another volume stands at the path.
    """
    available, unavailable, moves = [], [], {}
    for b in bindings:
        places = [m for m in mounts if m.identity == b.identity]
        target = f"{places[0].path.rstrip('/')}/{b.relative}".rstrip("/") or "/" if len(places) == 1 else None
        if target is None or not exists(target):
            unavailable.append(b.path)
            continue
        available.append(target)
        if target != b.path:
            moves[b.path] = target
    return Resolution(tuple(available), tuple(unavailable), moves)


def common_watch_folder(paths: list[str]) -> str:
    parts = [[p for p in path.split("/") if p] for path in paths]
    same = []
    for level in zip(*parts, strict=False):
        if len(set(level)) > 1:
            break
        same.append(level[0])
    return "/" + "/".join(same)


def resolve_locations(bindings: DataFrame, mounts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``path, identity, status, target`` of every binding (path, identity, relative): where its volume is mounted now.

    mounts: ``path, identity``; folders: ``path`` of all that exist, if that is
    known.  status: available (at its own path), moved (target is another
    path), offline (mounted nowhere), ambiguous (mounted more than once), or
    missing (the folder is not on its volume); target is null for the last
    three.  Joins on the identity and on the whole path; a binding without an
    identity is offline, rows that repeat stay.
    """
    # one row for each identity, so that no binding is multiplied
    places = mounts.where("identity is not null").groupBy("identity").agg(F.count_distinct("path").alias("_n"), F.min("path").alias("_mount"))
    rows = bindings.select("path", "identity", "relative").join(places, "identity", "left")
    relative = F.regexp_replace(F.coalesce("relative", F.lit("")), "^/+|/+$", "")
    joined = F.concat(F.regexp_replace("_mount", "/+$", ""), F.when(relative == "", "").otherwise(F.concat(F.lit("/"), relative)))
    rows = rows.withColumn("_target", F.when(F.col("_n") == 1, F.when(joined == "", "/").otherwise(joined)))
    exists = F.lit(True)
    if folders is not None:
        rows = rows.join(folders.select(F.col("path").alias("_target"), F.lit(True).alias("_exists")).distinct(), "_target", "left")
        exists = F.coalesce("_exists", F.lit(False))
    status = F.when(F.col("_n").isNull(), "offline").when(F.col("_n") > 1, "ambiguous").when(~exists, "missing").when(F.col("_target") == F.col("path"), "available").otherwise("moved")
    return rows.withColumn("status", status).select("path", "identity", "status", F.when(F.col("status").isin("available", "moved"), F.col("_target")).alias("target"))


def moves(resolved: DataFrame) -> DataFrame:
    """``source, target`` of the subtrees that ``mutate.relocate`` has to move, the outermost only: what lies inside one moves with it."""
    moved = resolved.where("status = 'moved'").select(F.col("path").alias("source"), "target").distinct()
    outer = hierarchy.minimal_cover(moved.select(F.col("source").alias("path")))
    return moved.join(outer.withColumnRenamed("path", "source"), "source", "left_semi")


def relative_paths(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """``path, volume, relative``: absolute paths by the longest mount (path, volume) that holds them; nulls where none does."""
    own = hierarchy.owner(paths.select("path"), mounts.select(F.col("path").alias("holder")))
    found = own.join(mounts.select(F.col("path").alias("owner"), "volume").dropDuplicates(["owner"]), "owner", "left")
    cut = F.when(F.col("owner") == "/", F.col("path")).otherwise(F.substring("path", F.length("owner") + 1, F.length("path")))
    return found.select("path", "volume", F.when(F.col("owner").isNotNull(), F.when(cut == "", "/").otherwise(cut)).alias("relative"))


def absolute_paths(rows: DataFrame, mounts: DataFrame) -> DataFrame:
    """Rows (volume, relative and others) with ``path``, on the volume's mount (path, volume); null for volumes that are not mounted."""
    found = rows.join(mounts.select("volume", F.col("path").alias("_mount")).dropDuplicates(["volume"]), "volume", "left")
    path = F.when(F.col("_mount") == "/", F.col("relative")).when(F.col("relative") == "/", F.col("_mount")).otherwise(F.concat("_mount", "relative"))
    return found.withColumn("path", path).drop("_mount")


def share_identities(urls: DataFrame) -> DataFrame:
    """``url, identity`` of network shares (column url)."""
    return urls.select("url", share_identity(F.col("url"), F.lit("smbfs")).alias("identity"))
