"""The change feed as a stream with keyed state: debounce and cooldown by timers, and a log that survives the driver.

Events are routed as in ``feed`` and meet their root's state (``transformWithState``):
what is pending there, when each path was flushed last, and one deadline.  A
flush is due 0.5 s after the first change; while flushes are frequent that
delay doubles, up to 8 s; a deadline that is set never moves back.  Timers fire
without further events, so nothing starves.  Paths that were flushed less than
``cooldown`` seconds ago wait, except recursive changes and whatever comes with
the end of a volume's history or an explicit flush.

Spark's checkpoint holds the state; the log beside it has for every batch what
was applied, what failed, and how far each volume may be taken as seen.  A
failed batch is kept in the shared folder and tried again, by this driver or
the next one, and a batch that a restarted query repeats is recognised.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import storage
from ..errors import StorageFailed
from ..operators.reconcile import ScanConfig
from ..schema import contains
from . import feed
from .feed import DIRECTORY, FILE, HISTORY_DONE, MAX_PENDING, RECURSIVE

# the state's code travels by value: no executor needs this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Flag of an event that asks for a flush of all roots of its volume (beyond the journal's own flags).
FLUSH = 1 << 40
#: Seconds from a change to its flush: at first, and at most while flushes are frequent.
DEBOUNCE, MAX_DEBOUNCE, COOLDOWN = 0.5, 8.0, 5.0
#: Seconds that a flush for what waits lies ahead at least.
LEAST_WAIT = 0.05
#: Flush times that a root remembers before those past their use go.
REMEMBERED = 4096

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTROL = -1
_OUT = "volume string, root string, kind string, path string, scope int, first_id long, id long, history boolean"


def routed(events: DataFrame, roots: dict[str, str], config: ScanConfig | None = None) -> DataFrame:
    """``volume, root, path, scope, id, flags``: a row for each place where something is due, and control rows for each root of the volume.

    ``roots``: the volume of each root.  Events of a volume concern its own roots.
    """
    found = None
    for volume in sorted(set(roots.values())):
        own = [r for r, v in roots.items() if v == volume]
        rows = events.where(F.col("volume") == volume)
        places = feed.route(rows.where(F.col("flags").bitwiseAND(F.lit(FLUSH)) == 0), own, config)
        # of nested roots the deepest has the path
        root = F.element_at(F.filter(F.array(*map(F.lit, sorted(own, key=len, reverse=True))), lambda r: contains(r, F.col("path"))), 1)
        places = places.select(root.alias("root"), "path", "scope", "id", F.lit(0).cast("long").alias("flags"))
        marks = rows.where(F.col("flags").bitwiseAND(F.lit(FLUSH | HISTORY_DONE)) != 0)
        marks = marks.select(F.explode(F.array(*map(F.lit, own))).alias("root"), F.lit("").alias("path"), F.lit(CONTROL).alias("scope"), "id", "flags")
        both = places.unionByName(marks).select(F.lit(volume).alias("volume"), "*")
        found = both if found is None else found.unionByName(both)
    return found


def compact(pending: dict[str, tuple[int, int, int]], root: str, bound: int) -> dict[str, tuple[int, int, int]]:
    """(scope, first id, id) by path without what another change covers; more than ``bound`` paths become one recursive change of the root."""

    def absorbed(a: tuple, b: tuple, scope: int) -> tuple:
        return scope, min(a[1], b[1]), max(a[2], b[2])

    kept: dict[str, tuple[int, int, int]] = {}
    for path in sorted(pending, key=lambda p: (p.count("/") if p != "/" else 0, p)):
        change, cover = pending[path], None
        parts = path.split("/")
        above = ["/"] + ["/".join(parts[:k]) for k in range(2, len(parts))] if path != "/" else []
        for folder in above:
            if folder in kept and (kept[folder][0] == RECURSIVE or (folder == above[-1] and kept[folder][0] == DIRECTORY and change[0] == FILE)):
                cover = folder
                break
        if cover is None:
            kept[path] = change
        else:
            kept[cover] = absorbed(kept[cover], change, kept[cover][0])
    if len(kept) > bound:
        return {root: (RECURSIVE, min(c[1] for c in kept.values()), max(c[2] for c in kept.values()))}
    return kept


@dataclass
class Clock:
    """A root's times in milliseconds and ids."""

    deadline: int = 0  # 0: none
    delay: int = 0
    ended: int = 0  # of the last flush
    seen: int = 0
    history: bool = False  # a mark that came and was not handed on
    history_id: int = 0


def schedule(clock: Clock, now: int, debounce: float, most: float, after: int | None = None) -> bool:
    """Sets the deadline for what has come; True if it is a new or an earlier one."""
    if after is None:
        if clock.deadline == 0:
            frequent = clock.ended and now - clock.ended < 1000 * most
            clock.delay = min(2 * clock.delay, int(1000 * most)) if frequent and clock.delay else int(1000 * debounce)
        after = clock.delay
    if clock.deadline and clock.deadline <= now + after:
        return False
    clock.deadline = now + after
    return True


def split(pending: dict, flushed: dict[str, int], now: int, cooldown: float, bypass: bool) -> tuple[dict, dict, int | None]:
    """(due changes, waiting ones, when the first of them may go)."""
    due, waiting, earliest = {}, {}, None
    for path, change in pending.items():
        at = flushed.get(path)
        if bypass or change[0] == RECURSIVE or at is None or now - at >= 1000 * cooldown:
            due[path] = change
        else:
            waiting[path] = change
            free = at + int(1000 * cooldown)
            earliest = free if earliest is None else min(earliest, free)
    return due, waiting, earliest


class Debounce(StatefulProcessor):
    """The state of one root; rows out are changes that are due and, after each step, one row ``status`` (least id that waits, greatest that came)."""

    def __init__(self, debounce: float = DEBOUNCE, most: float = MAX_DEBOUNCE, cooldown: float = COOLDOWN, bound: int = MAX_PENDING):
        self.debounce, self.most, self.cooldown, self.bound = debounce, most, cooldown, bound

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "scope int, first_id long, id long")
        self.flushed = handle.getMapState("flushed", "path string", "at long")
        self.clock = handle.getValueState("clock", "deadline long, delay long, ended long, seen long, history boolean, history_id long")

    def close(self) -> None:
        pass

    def _clock(self) -> Clock:
        return Clock(*self.clock.get()) if self.clock.exists() else Clock()

    def _set_timer(self, old: int, clock: Clock) -> None:
        if old and old != clock.deadline:
            self.handle.deleteTimer(old)
        if clock.deadline and old != clock.deadline:
            self.handle.registerTimer(clock.deadline)

    def _rows(self, key, due: dict, clock: Clock, history: bool):
        import pandas as pd

        volume, root = key
        waiting = min((c[1] for _, c in self.pending.iterator()), default=None)
        rows = [(volume, root, "change", p, *c, False) for p, c in due.items()]
        rows.append((volume, root, "status", None, None, waiting, clock.history_id if history and waiting is None and clock.history_id > clock.seen else clock.seen, history))
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])
        return frame.astype({"scope": "Int32", "first_id": "Int64", "id": "Int64"})

    def _flush(self, key, now: int, clock: Clock, bypass: bool):
        pending = compact({k[0]: tuple(v) for k, v in self.pending.iterator()}, key[1], self.bound)
        flushed = {k[0]: v[0] for k, v in self.flushed.iterator()}
        due, waiting, earliest = split(pending, flushed, now, self.cooldown, bypass or clock.history)
        self.pending.clear()
        for path, change in waiting.items():
            self.pending.updateValue((path,), change)
        for path in due:
            self.flushed.updateValue((path,), (now,))
        if len(flushed) > REMEMBERED:
            for path, at in flushed.items():
                if path not in due and now - at >= 2000 * self.cooldown:
                    self.flushed.removeKey((path,))
        clock.deadline, clock.ended, history = 0, now if due else clock.ended, clock.history
        if waiting:
            schedule(clock, now, self.debounce, self.most, max(int(1000 * LEAST_WAIT), earliest - now))
        frame = self._rows(key, due, clock, history)
        clock.history = False
        return frame

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now, clock = timerValues.getCurrentProcessingTimeInMs(), self._clock()
        old, at_once = clock.deadline, False
        for batch in rows:
            for path, scope, ident, flags in zip(batch["path"], batch["scope"], batch["id"], batch["flags"]):
                ident, flags = int(ident), int(flags)
                clock.seen = max(clock.seen, ident)
                if scope == CONTROL:
                    at_once = True
                    if flags & HISTORY_DONE:
                        clock.history, clock.history_id = True, max(clock.history_id, ident)
                    continue
                before = self.pending.getValue((path,)) if self.pending.containsKey((path,)) else (int(scope), ident, ident)
                self.pending.updateValue((path,), (max(before[0], int(scope)), min(before[1], ident), max(before[2], ident)))
        if at_once:
            frame = self._flush(key, now, clock, True)
        else:
            schedule(clock, now, self.debounce, self.most)
            frame = self._rows(key, {}, clock, False)
        self._set_timer(old, clock)
        self.clock.update(tuple(asdict(clock).values()))
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, clock = timerValues.getCurrentProcessingTimeInMs(), self._clock()
        if clock.deadline and expiredTimerInfo.getExpiryTimeInMs() >= clock.deadline:
            clock.deadline = 0
            frame = self._flush(key, now, clock, False)
            self._set_timer(0, clock)
            self.clock.update(tuple(asdict(clock).values()))
            yield frame


@dataclass
class Applied:
    """The log's last entry: a batch and all that was known after it."""

    batch: int = -1
    roots: dict = field(default_factory=dict)  # "volume\nroot": [least waiting id or None, greatest id]
    history: dict = field(default_factory=dict)  # volume: roots whose history has ended
    failed: list = field(default_factory=list)  # folders of changes to be tried again
    retry_at: float = 0.0


class StateLog:
    """One small file for each batch that changed something, in the shared folder; the latest counts, a few older ones are kept."""

    KEPT = 10

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.last = self.load()

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, self.folder) if n.endswith(".json") and not n.startswith(".")]

    def load(self) -> Applied:
        numbers = self._numbers()
        return Applied(**json.loads(storage.read_text(self.spark, f"{self.folder}/{max(numbers):012d}.json"))) if numbers else Applied()

    def commit(self, entry: Applied) -> None:
        storage.write_text(self.spark, f"{self.folder}/{entry.batch:012d}.json", json.dumps(asdict(entry)), replace=True)
        self.last = entry
        for n in sorted(self._numbers())[: -self.KEPT]:
            storage.delete(self.spark, f"{self.folder}/{n:012d}.json")

    def cursors(self, volumes: dict[str, list[str]] | None = None) -> dict[str, int]:
        """The id of each volume up to which all is applied: where a stream without Spark's checkpoint may begin (``since``)."""
        least: dict[str, int] = {}
        most: dict[str, int] = {}
        for key, (waiting, seen) in self.last.roots.items():
            volume = key.split("\n")[0]
            most[volume] = max(most.get(volume, 0), seen)
            if waiting is not None:
                least[volume] = min(least.get(volume, waiting), waiting)
        for _, first in self.last.failed:
            for volume, ident in first.items():
                least[volume] = min(least.get(volume, ident), ident)
        return {v: max(0, least[v] - 1) if v in least else most[v] for v in most}


class LiveFeed:
    """What ``foreachBatch`` calls: applies what is due, once, and logs it."""

    def __init__(self, spark: SparkSession, apply: Callable[[DataFrame, int], None], folder: str, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.time, on_commit: Callable[[dict], None] | None = None):
        self.spark, self.apply, self.folder, self.cooldown, self.clock, self.on_commit = spark, apply, folder.rstrip("/"), cooldown, clock, on_commit
        self.log = StateLog(spark, f"{self.folder}/log")
        self.failure: Exception | None = None

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of ``Debounce``; a batch that the log has is skipped.  What fails here but ``apply`` (the log, the stream's own work) ends the query."""
        try:
            self._batch(rows, batch_id)
        except Exception as e:
            # the JVM looks through the whole text of an error that comes from here, and overflows its stack on a long one
            raise StorageFailed(f"batch {batch_id}: {type(e).__name__}: {str(e)[:300]}") from None

    def _batch(self, rows: DataFrame, batch_id: int) -> None:
        last = self.log.last
        if batch_id <= last.batch:
            return
        rows = rows.persist()
        try:
            status = rows.where("kind = 'status'").withColumn("at", F.monotonically_increasing_id()).groupBy("volume", "root").agg(F.max_by("first_id", "at").alias("waiting"), F.max("id").alias("seen"), F.bool_or("history").alias("history")).collect()  # a row for each root
            retry = bool(last.failed) and self.clock() >= last.retry_at
            if not status and not retry:
                return
            entry = Applied(batch_id, dict(last.roots), {v: list(r) for v, r in last.history.items()}, list(last.failed), last.retry_at)
            for r in status:
                key = f"{r.volume}\n{r.root}"
                entry.roots[key] = [r.waiting, max(r.seen or 0, last.roots.get(key, [None, 0])[1])]
            due = rows.where("kind = 'change'").select("volume", "root", "path", "scope", "first_id", "id")
            folders = [f for f, _ in last.failed] if retry else []
            for f in folders:
                due = due.unionByName(self.spark.read.schema(due.schema).parquet(f))
            due = due.groupBy("volume", "root", "path").agg(F.max("scope").alias("scope"), F.min("first_id").alias("first_id"), F.max("id").alias("id"))
            due = due.persist()
            try:
                first = {r.volume: r.first_id for r in due.groupBy("volume").agg(F.min("first_id").alias("first_id")).collect()}
                if first:
                    try:
                        self.apply(due, batch_id)
                        if retry:
                            entry.failed = []
                        self.failure = None
                    except Exception as e:
                        self.failure = e
                        kept = f"{self.folder}/failed/{batch_id:012d}"
                        due.write.mode("overwrite").parquet(kept)
                        entry.failed = [x for x in entry.failed if x[0] not in folders] + [[kept, first]]
                        entry.retry_at = self.clock() + self.cooldown
            finally:
                due.unpersist()
            for r in status:
                if r.history:
                    entry.history[r.volume] = sorted({*entry.history.get(r.volume, []), r.root})
            self.log.commit(entry)
            for f in folders:
                storage.delete(self.spark, f)
            if self.on_commit:
                self.on_commit(self.log.cursors())
        finally:
            rows.unpersist()

    def history_done(self, roots: dict[str, str]) -> dict[str, bool]:
        """Of each volume, whether the end of its history has come to all its roots."""
        return {v: set(self.log.last.history.get(v, [])) >= {r for r, own in roots.items() if own == v} for v in set(roots.values())}


def changes(events: DataFrame, roots: dict[str, str], config: ScanConfig | None = None, **times) -> DataFrame:
    """The stream of due changes and status rows (``times``: of Debounce)."""
    return routed(events, roots, config).groupBy("volume", "root").transformWithStateInPandas(Debounce(**times), _OUT, "append", "processingTime")


def start(events: DataFrame, roots: dict[str, str], apply, checkpoint: str, interval: str = "200 milliseconds", config: ScanConfig | None = None, clock=time.time, on_commit=None, once: bool = False, **times):
    """Runs the feed until it is stopped: ``apply(changes, batch_id)`` gets ``volume, root, path, scope, first_id, id``.

    ``apply`` must tolerate a repeated change.  The query has its ``feed``.
    ``checkpoint``: a shared folder; a query that is started there again goes
    on where the last one stood.
    """
    spark = events.sparkSession
    live = LiveFeed(spark, apply, f"{checkpoint}/feed", times.get("cooldown", COOLDOWN), clock, on_commit)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        writer = changes(events, roots, config, **times).writeStream.foreachBatch(live.batch).option("checkpointLocation", f"{checkpoint}/stream")
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.feed = live
    return query
