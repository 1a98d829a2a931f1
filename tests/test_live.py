"""The feed as a stream: keyed state with timers, a log that survives, journals that are replayed."""

import json
import time

import pytest

from treelens.sources import journal
from treelens.streaming import feed, live
from treelens.streaming.feed import DIRECTORY, FILE, RECURSIVE

EDIT, NEW = feed.MODIFIED | feed.IS_FILE, feed.CREATED | feed.IS_FILE
ROOTS = {"/r": "v1", "/q/s": "v1", "/w": "v2"}


def test_compact():
    pending = {"/r/a/x": (FILE, 5, 9), "/r/a": (DIRECTORY, 3, 4), "/r/a/b/y": (FILE, 1, 1), "/r/c": (RECURSIVE, 7, 7), "/r/c/d/e": (DIRECTORY, 2, 8)}
    assert live.compact(pending, "/r", 10) == {"/r/a": (DIRECTORY, 3, 9), "/r/a/b/y": (FILE, 1, 1), "/r/c": (RECURSIVE, 2, 8)}
    assert live.compact(pending, "/r", 2) == {"/r": (RECURSIVE, 1, 9)}
    assert live.compact({"/": (RECURSIVE, 4, 4), "/a": (FILE, 2, 2)}, "/", 9) == {"/": (RECURSIVE, 2, 4)}


def test_delay_doubles_and_a_deadline_never_moves_back():
    clock, now, delays = live.Clock(), 100_000, []
    for _ in range(7):
        assert live.schedule(clock, now, 0.5, 8.0)
        assert not live.schedule(clock, now + 100, 0.5, 8.0)  # more changes: the deadline stays
        delays.append(clock.deadline - now)
        now = clock.ended = clock.deadline
        clock.deadline = 0
        now += 10
    assert delays == [500, 1000, 2000, 4000, 8000, 8000, 8000]
    now += 8000
    assert live.schedule(clock, now, 0.5, 8.0) and clock.deadline - now == 500  # quiet for long enough
    assert live.schedule(clock, now, 0.5, 8.0, 50) and clock.deadline - now == 50  # an earlier one


def test_cooldown():
    pending = {"/a": (FILE, 1, 2), "/b": (RECURSIVE, 3, 3), "/c": (FILE, 4, 4), "/d": (FILE, 5, 5)}
    due, waiting, earliest = live.split(pending, {"/a": 98_000, "/b": 99_000, "/c": 90_000, "/d": 97_000}, 100_000, 5.0, False)
    assert set(due) == {"/b", "/c"} and set(waiting) == {"/a", "/d"} and earliest == 102_000
    assert live.split(pending, {"/a": 98_000}, 100_000, 5.0, True)[1] == {}


@pytest.fixture()
def write(spark, tmp_path):
    """Appends events to the journal, each (volume, id, path, flags)."""
    return lambda *events, **more: journal.write_events(spark.createDataFrame(list(events), journal.SCHEMA), str(tmp_path / "journal"), **more)


class Applied:
    def __init__(self, failures=0):
        self.rows, self.failures, self.times = [], failures, {}

    def __call__(self, df, batch_id):
        if self.failures:
            self.failures -= 1
            raise OSError("the catalog is away")
        for r in df.collect():
            self.rows.append((r.path, r.scope, r.first_id, r.id))
            self.times.setdefault(r.path, []).append(time.time())

    def paths(self):
        return {r[0] for r in self.rows}


def until(condition, query, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert query.exception() is None, query.exception()
        assert time.time() < end, "nothing came"
        time.sleep(0.1)


def run(spark, tmp_path, applied, since=None, name="cp", **times):
    events = journal.stream(spark, str(tmp_path / "journal"), since)
    return live.start(events, ROOTS, applied, str(tmp_path / name), **({"debounce": 0.2, "most": 0.4, "cooldown": 3.0} | times))


def test_source_offsets_and_replay(spark, tmp_path, write):
    write(*[("v1", i, f"/r/{i}", EDIT) for i in range(1, 26)], *[("v/2", i, f"/w/{i}", EDIT) for i in range(100, 110)], segment_events=10)
    reader = journal.JournalReader(str(tmp_path / "journal"), {"v1": 7})
    assert reader.initialOffset()["volumes"] == {"v1": 7} and reader.latestOffset()["volumes"] == {"v1": 25, "v/2": 109}

    def ids(start, end):
        return sorted((v, i) for p in reader.partitions({"volumes": start}, {"volumes": end}) for b in reader.read(p) for v, i in zip(b.column("volume").to_pylist(), b.column("id").to_pylist()))

    assert ids({"v1": 7}, {"v1": 12}) == [("v1", i) for i in range(8, 13)]
    assert ids({"v1": 25}, {"v1": 25, "v/2": 101}) == [("v/2", 100), ("v/2", 101)]
    assert ids({"v1": 25, "v/2": 109}, reader.latestOffset()["volumes"]) == []
    assert len(reader.partitions({"volumes": {"v1": 12}}, {"volumes": {"v1": 20}})) <= 2  # segments outside the offsets are not opened
    write(("v1", 26, "/r/26", EDIT))
    write(("v1", 26, "/r/26", EDIT))  # a task that runs again
    assert reader.latestOffset()["volumes"]["v1"] == 26 and ids({"v1": 25, "v/2": 109}, reader.latestOffset()["volumes"]) == [("v1", 26)]
    # through Spark: a stream from a saved cursor sees each event behind it, once, also when it is stopped and started again
    seen = []
    for more in ((), (("v1", 27, "/r/27", EDIT),)):
        if more:
            write(*more)
        query = journal.stream(spark, str(tmp_path / "journal"), {"v1": 20, "v/2": 105}).writeStream.foreachBatch(lambda df, b: seen.extend((r.volume, r.id) for r in df.collect())).option("checkpointLocation", str(tmp_path / "raw")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(seen) == [("v/2", i) for i in range(106, 110)] + [("v1", i) for i in range(21, 28)]


def test_what_waits_is_flushed_without_further_events(spark, tmp_path, write):
    applied = Applied()
    write(("v1", 1, "/r/a", EDIT), ("v1", 2, "/q/s/x", NEW), ("v2", 5, "/w/f", EDIT), ("v1", 3, "/elsewhere", EDIT))
    query = run(spark, tmp_path, applied)
    try:
        until(lambda: applied.paths() == {"/r/a", "/q/s", "/w/f"}, query)
        write(("v1", 10, "/r/a", EDIT), ("v1", 11, "/r/b", EDIT), ("v2", 12, "/w", feed.MUST_SCAN))
        until(lambda: "/r/b" in applied.paths() and len(applied.times.get("/w", [])) == 1, query)
        if ("/r/a", FILE, 10, 10) not in applied.rows:  # it waits: the cursor stays below it
            assert query.feed.log.cursors()["v1"] == 9
        until(lambda: ("/r/a", FILE, 10, 10) in applied.rows, query)  # no event came since
        assert applied.times["/r/a"][1] - applied.times["/r/a"][0] >= 2.0
        until(lambda: query.feed.log.cursors() == {"v1": 11, "v2": 12}, query)
        # a flush that is asked for does not wait
        write(("v1", 20, "/r/a", EDIT), ("v1", 21, "/", live.FLUSH))
        until(lambda: ("/r/a", FILE, 20, 20) in applied.rows, query)
        # nor does the end of the history, which is each volume's own
        assert query.feed.history_done(ROOTS) == {"v1": False, "v2": False}
        write(("v2", 30, "/", feed.HISTORY_DONE))
        until(lambda: query.feed.history_done(ROOTS) == {"v1": False, "v2": True}, query)
        until(lambda: query.feed.log.cursors() == {"v1": 21, "v2": 30}, query)
    finally:
        query.stop()


def test_a_driver_that_dies_loses_nothing(spark, tmp_path, write):
    """Apply fails, the query ends, another one starts: all changes are applied, and a cursor never passes what is not."""
    write(("v1", 5, "/r/a", EDIT), ("v1", 6, "/r/b", EDIT))
    failing = Applied(failures=1000)
    query = run(spark, tmp_path, failing, cooldown=0.5)
    try:
        until(lambda: query.feed.log.last.failed, query)
        assert query.feed.log.cursors()["v1"] == 4
        write(("v1", 9, "/r/c", NEW))
        before = query.feed.log.last.batch
        until(lambda: query.feed.log.last.batch > before and query.feed.log.last.roots["v1\n/r"][1] == 9, query)
    finally:
        query.stop()
    applied, saved = Applied(), []
    query = live.start(journal.stream(spark, str(tmp_path / "journal")), ROOTS, applied, str(tmp_path / "cp"), cooldown=0.5, debounce=0.2, most=0.4, on_commit=lambda c: saved.append(json.dumps(c)))
    try:
        assert query.feed.log.last.failed  # loaded from the shared folder
        until(lambda: applied.paths() >= {"/r/a", "/r/b", "/r"}, query)
        until(lambda: query.feed.log.cursors() == {"v1": 9} and not query.feed.log.last.failed, query)
        until(lambda: saved and json.loads(saved[-1]) == {"v1": 9}, query)
    finally:
        query.stop()
    # from the saved cursor alone, without Spark's checkpoint
    write(("v1", 12, "/r/z", EDIT))
    fresh = Applied()
    query = run(spark, tmp_path, fresh, since=json.loads(saved[-1]), name="other")
    try:
        until(lambda: fresh.rows == [("/r/z", FILE, 12, 12)], query)
    finally:
        query.stop()


def test_a_repeated_batch_is_skipped(spark, tmp_path):
    applied = Applied()
    rows = [("v1", "/r", "change", "/r/a", 0, 3, 4, False), ("v1", "/r", "status", None, None, None, 4, True)]
    schema = "volume string, root string, kind string, path string, scope int, first_id long, id long, history boolean"
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    one = live.LiveFeed(spark, applied, str(tmp_path))
    one.batch(frame, 7)
    live.LiveFeed(spark, applied, str(tmp_path)).batch(frame, 7)  # the driver died before Spark noted the batch
    assert applied.rows == [("/r/a", 0, 3, 4)] and live.StateLog(spark, f"{tmp_path}/log").cursors() == {"v1": 4}
    assert one.history_done({"/r": "v1"}) == {"v1": True} and one.history_done({"/r": "v1", "/x": "v1"}) == {"v1": False}
    # a failed batch waits for its time, and its retry takes in what came since
    now = [100.0]
    flaky = live.LiveFeed(spark, Applied(failures=1), str(tmp_path), cooldown=5.0, clock=lambda: now[0])
    flaky.batch(frame, 8)
    flaky.batch(frame.where("kind = 'none'"), 9)
    assert flaky.apply.rows == [] and flaky.log.cursors() == {"v1": 2} and flaky.failure is not None
    now[0] += 6
    later = spark.createDataFrame([("v1", "/r", "change", "/r/a", 1, 5, 6, False), ("v1", "/r", "status", None, None, None, 6, False)], schema).coalesce(1)
    flaky.batch(later, 10)
    assert flaky.apply.rows == [("/r/a", 1, 3, 6)] and flaky.log.cursors() == {"v1": 6} and flaky.failure is None
