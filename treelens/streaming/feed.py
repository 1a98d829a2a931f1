"""The change feed: events to pending changes, coalesced, with a cursor; batch functions and the stream around them."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..operators.reconcile import ScanConfig, excluded_path
from ..schema import ancestors, contains, normalised, parent_path
from ..storage import new_folder

# Bits of an event's flags.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, HISTORY_DONE, ROOT_CHANGED, MOUNT, UNMOUNT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80
CREATED, REMOVED, RENAMED, MODIFIED, IS_FILE, IS_DIR, IS_LINK = 0x100, 0x200, 0x800, 0x1000, 0x10000, 0x20000, 0x40000

#: Scopes of a change in rising order.
FILE, DIRECTORY, RECURSIVE = 0, 1, 2
#: Pending paths at most; beyond them the whole of every root is due.
MAX_PENDING = 16_384


def _has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def is_file_item(flags: Column) -> Column:
    return _has(flags, IS_FILE | IS_LINK) & ~_has(flags, IS_DIR)


def changes_name(flags: Column) -> Column:
    return is_file_item(flags) & _has(flags, CREATED | REMOVED | RENAMED)


def replaces_folder(flags: Column) -> Column:
    return _has(flags, IS_DIR) & _has(flags, CREATED | RENAMED)


def needs_full_scan(flags: Column) -> Column:
    return _has(flags, USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED)


def needs_recursive_scan(flags: Column) -> Column:
    return _has(flags, MUST_SCAN | ROOT_CHANGED | MOUNT | UNMOUNT)


def history_done(events: DataFrame) -> DataFrame:
    """One row: whether a history marker came, and its largest id."""
    marks = events.where(_has(F.col("flags"), HISTORY_DONE))
    return marks.agg((F.count("*") > 0).alias("done"), F.coalesce(F.max("id"), F.lit(0)).alias("id"))


def history_by_volume(events: DataFrame, volumes: DataFrame) -> DataFrame:
    """``volume, done, id, finished`` of every volume (column volume): whether its marker came, the largest id of one, and whether all volumes' have."""
    marks = events.where(_has(F.col("flags"), HISTORY_DONE)).groupBy("volume").agg(F.max("id").alias("id"))
    each = volumes.select("volume").distinct().join(marks, "volume", "left").select("volume", F.col("id").isNotNull().alias("done"), F.coalesce("id", F.lit(0)).alias("id"))
    return each.crossJoin(F.broadcast(each.agg(F.coalesce(F.bool_and("done"), F.lit(False)).alias("finished"))))  # one row on the right


def translate(events: DataFrame, mappings: DataFrame) -> DataFrame:
    """Event paths from canonical to configured form: the longest mapping (canonical, configured) that contains them."""
    own = hierarchy.owner(events, mappings.select(F.col("canonical").alias("holder")))
    found = own.join(mappings.select(F.col("canonical").alias("owner"), "configured"), "owner", "left")
    path = F.when(F.col("configured").isNull(), F.col("path")).otherwise(F.concat("configured", F.substring(F.col("path"), F.length("owner") + 1, F.length("path"))))
    return found.select(*[path.alias(c) if c == "path" else c for c in events.columns])


def route(events: DataFrame, roots: list[str], config: ScanConfig | None = None) -> DataFrame:
    """``path, scope, id`` per event: where something is due, and how deep.

    Dropped events make every root due; events above a root make that root
    due; a file whose name changed makes its folder due; others stay at their
    path.  Paths outside all roots and excluded ones are dropped.
    """
    config = config or ScanConfig(tuple(roots), prefixes=(), names=())
    flags = F.col("flags")
    rows = events.where(~_has(flags, HISTORY_DONE)).withColumn("path", normalised(F.col("path")))
    all_roots = F.array(*map(F.lit, roots)) if roots else F.array().cast("array<string>")
    inside = F.exists(all_roots, lambda r: contains(r, F.col("path"))) & ~excluded_path(F.col("path"), config)
    above = F.filter(all_roots, lambda r: contains(F.col("path"), r))
    usable = F.filter(all_roots, lambda r: ~excluded_path(r, config))
    scope = F.when(needs_recursive_scan(flags) | replaces_folder(flags), RECURSIVE).when(is_file_item(flags) & ~changes_name(flags), FILE).otherwise(DIRECTORY)
    folder = parent_path(F.col("path"))
    target = F.when(changes_name(flags) & F.exists(all_roots, lambda r: contains(r, folder)), folder).otherwise(F.col("path"))
    one = F.struct(target.alias("path"), scope.alias("scope"))
    due = (
        F.when(needs_full_scan(flags), F.transform(all_roots, lambda r: F.struct(r.alias("path"), F.lit(RECURSIVE).alias("scope"))))
        .when(inside, F.array(one))
        .otherwise(F.transform(F.array_intersect(above, usable), lambda r: F.struct(r.alias("path"), F.lit(RECURSIVE).alias("scope"))))
    )
    return rows.select("id", F.explode(due).alias("d")).select("d.path", "d.scope", "id")


def _merge(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.max("scope").alias("scope"), F.min("first_id").alias("first_id"), F.max("id").alias("id"))


def coalesce(routed: DataFrame, roots: list[str], max_pending: int = MAX_PENDING) -> DataFrame:
    """``path, scope, first_id, id``: one pending change per path, none inside a recursive one, no file in a due folder.

    More than ``max_pending`` paths become a recursive change of every root.
    """
    return _covered(_merge(routed.select("path", "scope", F.col("id").alias("first_id"), "id")), roots, max_pending)


def _covered(pending: DataFrame, roots: list[str], max_pending: int) -> DataFrame:
    folders = pending.where(F.col("scope") >= DIRECTORY).select(F.col("path").alias("cover"), F.col("scope").alias("cover_scope"))
    up = pending.withColumn("cover", F.explode(ancestors(F.col("path")))).join(folders, "cover")
    direct = (F.col("cover") == parent_path(F.col("path"))) & (F.col("cover_scope") == DIRECTORY) & (F.col("scope") == FILE)
    covered = up.where((F.col("cover_scope") == RECURSIVE) | direct).groupBy("path").agg(F.min_by("cover", F.length("cover")).alias("cover"))
    # what a cover absorbs raises its ids, not its depth
    target = pending.join(covered, "path", "left").select(F.coalesce("cover", "path").alias("path"), F.when(F.col("cover").isNull(), F.col("scope")).otherwise(FILE).alias("scope"), "first_id", "id")
    merged = _merge(target)
    count = merged.agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"), F.max("id").alias("id"))
    full = count.where(F.col("n") > max_pending).select(F.explode(F.array(*map(F.lit, roots))).alias("path"), F.lit(RECURSIVE).alias("scope"), "first_id", "id") if roots else None
    if full is None:
        return merged
    few = merged.crossJoin(F.broadcast(count.select("n"))).where(F.col("n") <= max_pending).drop("n")  # one row on the right
    return few.unionByName(full)


def cursor(flushed: DataFrame, deferred: DataFrame, marker: int = 0) -> DataFrame:
    """One row ``cursor``: where a restart may begin. The largest id seen, or just below the first deferred one."""
    seen = flushed.agg(F.max("id").alias("seen"))
    waiting = deferred.agg(F.min("first_id").alias("waiting"))
    both = seen.crossJoin(waiting)  # one row each
    return both.select(F.greatest(F.lit(0), F.when(F.col("waiting").isNotNull(), F.col("waiting") - 1).otherwise(F.greatest(F.coalesce("seen", F.lit(0)), F.lit(marker)))).cast("long").alias("cursor"))


def defer(pending: DataFrame, last_flush: DataFrame, now: float, cooldown: float = 5.0) -> DataFrame:
    """Adds ``due``: false within ``cooldown`` seconds of the path's last flush (path, at); recursive changes never wait."""
    return pending.join(last_flush, "path", "left").withColumn("due", F.col("at").isNull() | (F.col("scope") == RECURSIVE) | (F.lit(now) - F.col("at") >= cooldown)).drop("at")


@dataclass
class State:
    """What a feed carries from one micro-batch to the next: two tables in the shared folder, and some numbers."""

    pending: str | None = None  # folder of changes that wait: path, scope, first_id, id
    flushed: str | None = None  # folder of the last flush of each path that may have to wait: path, at
    seen: int = 0  # the largest id that came
    cursor: int = 0
    marker: int = 0
    history: bool = False


class Feed:
    """Routes and coalesces micro-batches, lets quiet paths through and hands them to ``apply(changes, batch_id)``.

    A path that was flushed less than ``cooldown`` seconds ago waits; the cursor
    stays below what waits.  If ``apply`` fails, nothing is taken as flushed:
    all changes stay pending, are merged with the next batch and tried again,
    and the cursor does not move.  ``apply`` must tolerate a repeated change
    (reconciling compares states, so a replay changes nothing).
    """

    def __init__(self, spark: SparkSession, roots: list[str], apply, config: ScanConfig | None = None, cooldown: float = 5.0, max_pending: int = MAX_PENDING, clock=time.time, state: State | None = None, mappings: DataFrame | None = None):
        self.spark, self.roots, self.apply, self.config = spark, roots, apply, config
        self.cooldown, self.max_pending, self.clock, self.mappings = cooldown, max_pending, clock, mappings
        self.state = state or State()

    def _read(self, folder: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(folder) if folder else self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame:
        return self._read(self.state.pending, "path string, scope int, first_id long, id long")

    def _kept(self, rows: DataFrame, name: str) -> str:
        folder = new_folder(self.spark, name)
        rows.write.parquet(folder)
        return folder

    def batch(self, events: DataFrame, batch_id: int = 0) -> State:
        """One micro-batch; an empty one flushes what has waited long enough."""
        now, before = self.clock(), self.state
        events = translate(events, self.mappings) if self.mappings is not None else events
        marks = history_done(events).first()
        # what waits already goes in again: a cover that came since absorbs it
        due = _merge(route(events, self.roots, self.config).select("path", "scope", F.col("id").alias("first_id"), "id").unionByName(self.pending()))
        seen = max(before.seen, events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        flushed = self._read(before.flushed, "path string, at double")
        due = self._kept(defer(_covered(due, self.roots, self.max_pending), flushed, now, self.cooldown), "due")
        rows = self.spark.read.parquet(due)
        marker = max(before.marker, marks.id)
        try:
            ready = rows.where("due").drop("due")
            if not ready.isEmpty():
                self.apply(ready, batch_id)
        except Exception:
            self.state = replace(before, pending=due, seen=seen, marker=marker)
            raise
        waiting = rows.where("not due").drop("due")
        recent = flushed.join(rows.where("due").select("path"), "path", "left_anti").unionByName(rows.where("due").select("path", F.lit(now).cast("double").alias("at")))
        top = cursor(self.spark.createDataFrame([(seen,)], "id long"), waiting, marker).first()[0]
        self.state = State(self._kept(waiting, "pending"), self._kept(recent.where(F.lit(now) - F.col("at") < self.cooldown), "flushed"), seen, max(before.cursor, top), marker, before.history or marks.done)
        return self.state


def start(events: DataFrame, roots: list[str], apply, checkpoint: str, interval: str = "500 milliseconds", config: ScanConfig | None = None, once: bool = False, **options):
    """Runs a Feed: every micro-batch goes through ``Feed.batch`` (options: its cooldown, max_pending, clock, state, mappings).

    A failed ``apply`` is not the stream's end: its changes wait for the next
    batch.  The stream's checkpoint is the durable cursor of what was read,
    ``feed.state.cursor`` that of what was applied; the query has its ``feed``.
    """
    feed = Feed(events.sparkSession, roots, apply, config, **options)

    def batch(df: DataFrame, batch_id: int) -> None:
        try:
            feed.batch(df, batch_id)
        except Exception as e:  # kept pending by the feed
            feed.failure = e

    feed.failure = None
    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    query.feed = feed
    return query
