from treelens.operators import volumes
from treelens.operators.volumes import Binding, Mount, common_watch_folder, resolve, volumes_for
from treelens.streaming import feed
from treelens.streaming.checkpoint import Checkpoint, CheckpointFile, VolumeCursor

SCHEMA = "id long, path string, flags long"
EDIT, NEW = feed.MODIFIED | feed.IS_FILE, feed.CREATED | feed.IS_FILE


def run(spark, events, roots, bound=feed.MAX_PENDING):
    routed = feed.route(spark.createDataFrame(events, SCHEMA), roots)
    return {(r.path, r.scope, r.first_id, r.id) for r in feed.coalesce(routed, roots, bound).collect()}


def test_duplicates_and_replay(spark):
    events = [(i + 1, f"/r/f{i % 8}", EDIT) for i in range(2048)]
    got = run(spark, events, ["/r"])
    assert len(got) == 8 and max(g[3] for g in got) == 2048
    assert {g[:2] for g in run(spark, events * 2, ["/r"])} == {g[:2] for g in got}


def test_routing_and_cover(spark):
    assert run(spark, [(1, "/r/a/x", EDIT)] + [(k, f"/r/a/n{k}", NEW) for k in range(2, 130)], ["/r"]) == {("/r/a", feed.DIRECTORY, 1, 129)}
    assert run(spark, [(10, "/r/a/b/f", EDIT), (20, "/r/a/b", feed.MUST_SCAN), (30, "/r", feed.MUST_SCAN)], ["/r"]) == {("/r", feed.RECURSIVE, 10, 30)}
    assert run(spark, [(5, "/", feed.MUST_SCAN)], ["/r", "/q/s"]) == {("/r", 2, 5, 5), ("/q/s", 2, 5, 5)}
    assert run(spark, [(5, "/else/x", EDIT)], ["/r"]) == set()
    assert run(spark, [(5, "/r/x", feed.USER_DROPPED)], ["/r", "/q"]) == {("/r", 2, 5, 5), ("/q", 2, 5, 5)}
    assert run(spark, [(k, f"/r/f{k}", EDIT) for k in range(1, 33)], ["/r", "/q"], 4) == {("/r", 2, 1, 32), ("/q", 2, 1, 32)}


def test_cursor_and_cooldown(spark):
    flushed = spark.createDataFrame([(10, 10), (50, 50)], "first_id long, id long")
    waiting = spark.createDataFrame([(20, 40)], "first_id long, id long")
    assert feed.cursor(flushed, waiting).first().cursor == 19 and feed.cursor(flushed, waiting.limit(0)).first().cursor == 50
    assert feed.cursor(flushed.limit(0), waiting.limit(0), 77).first().cursor == 77
    pending = spark.createDataFrame([("/a", 0), ("/b", 2), ("/c", 1)], "path string, scope int")
    last = spark.createDataFrame([("/a", 98.0), ("/b", 99.0), ("/c", 90.0)], "path string, at double")
    assert {r.path: r.due for r in feed.defer(pending, last, 100.0).collect()} == {"/a": False, "/b": True, "/c": True}


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, f"/r/f{i}", EDIT) for i in range(4)], SCHEMA).write.mode("append").parquet(str(tmp_path / "events"))
    events, seen = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events")), []

    def go():
        feed.start(events, ["/r"], lambda df, batch: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()

    go()
    assert set(seen) == {f"/r/f{i}" for i in range(4)}
    count = len(seen)
    go()  # nothing new: the checkpoint holds the cursor
    assert len(seen) == count


def test_checkpoints(tmp_path):
    day, volumes = 24 * 3600.0, [VolumeCursor("v", "j", 42)]
    saved = Checkpoint("db", {"roots": ["/"]}, 1000.0, volumes)

    def valid(v=("v", "j", 50), config=None, now=1001.0, db="db"):
        return saved.valid(db, config or {"roots": ["/"]}, [], [VolumeCursor(*v)], now)

    assert valid() and not valid(("v", "j", 41)) and not valid(("v", "k", 50)) and not valid(now=1000 + 7 * day) and not valid(now=999.0) and not valid(config={"roots": []}) and not valid(db="x")
    file = CheckpointFile(str(tmp_path / "c"))
    assert file.load() is None and file.save(saved) and not file.save(Checkpoint("db", {"roots": ["/"]}, 2000.0, [VolumeCursor("v", "j", 40)]))
    assert CheckpointFile(str(tmp_path / "c")).load().volumes[0].id == 42


def test_volumes():
    mounts = [Mount("/", "root"), Mount("/Volumes/Work", "w"), Mount("/Volumes/Other", "o")]
    assert volumes_for(["/Users/example"], mounts) == ["/"] and volumes_for(["/"], mounts, lambda p: p == "/Volumes/Other") == ["/", "/Volumes/Work"]
    moved = [Mount("/Volumes/Work 1", "uuid:work")]
    r = resolve([Binding("/Volumes/Work/projects", "uuid:work", "projects")], moved)
    assert r.moves == {"/Volumes/Work/projects": "/Volumes/Work 1/projects"}
    assert resolve([Binding("/Volumes/Work/projects", "uuid:work", "projects")], moved * 2).unavailable == ("/Volumes/Work/projects",)
    assert resolve([Binding("/Volumes/Work/projects", "uuid:work", "projects")], moved, lambda p: False).moves == {}
    assert common_watch_folder(["/a/b/c", "/a/b/d/e"]) == "/a/b" and common_watch_folder(["/a", "/b"]) == "/"


def test_locations_on_tables(spark):
    bindings = [("/Volumes/Work/projects", "w", "projects"), ("/Volumes/Work/projects/in", "w", "projects/in"), ("/Home", "h", ""), ("/Volumes/Twice", "t", ""), ("/Volumes/Gone/x", "g", "x"), ("/Volumes/Work/none", "w", "/none/"), ("/Volumes/Null", None, "")]
    mounts = [("/Volumes/Work 1", "w"), ("/Volumes/Work 1", "w"), ("/Home", "h"), ("/a", "t"), ("/b", "t"), ("/c", None)]
    folders = [(p,) for p in ("/Volumes/Work 1/projects", "/Volumes/Work 1/projects/in", "/Home", "/a", "/b")]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    found = volumes.resolve_locations(frame(bindings, "path string, identity string, relative string"), frame(mounts, "path string, identity string"), frame(folders, "path string"))
    assert {r.path: (r.status, r.target) for r in found.collect()} == {
        "/Volumes/Work/projects": ("moved", "/Volumes/Work 1/projects"), "/Volumes/Work/projects/in": ("moved", "/Volumes/Work 1/projects/in"), "/Home": ("available", "/Home"), "/Volumes/Twice": ("ambiguous", None),
        "/Volumes/Gone/x": ("offline", None), "/Volumes/Work/none": ("missing", None), "/Volumes/Null": ("offline", None),
    }
    assert [tuple(r) for r in volumes.moves(found).collect()] == [("/Volumes/Work/projects", "/Volumes/Work 1/projects")]
    mounts = frame([("/", "root"), ("/v", "v"), ("/v/w", "w")], "path string, volume string")
    own = volumes.relative_paths(frame([("/v/w/a",), ("/v/wa",), ("/v",), ("/x",), ("/",)], "path string"), mounts)
    assert {tuple(r) for r in own.collect()} == {("/v/w/a", "w", "/a"), ("/v/wa", "v", "/wa"), ("/v", "v", "/"), ("/x", "root", "/x"), ("/", "root", "/")}
    back = volumes.absolute_paths(own.withColumnRenamed("path", "was"), mounts)
    assert all(r.was == r.path for r in back.collect())


def test_history_by_volume(spark):
    events = spark.createDataFrame([("a", 5, feed.HISTORY_DONE), ("a", 9, feed.HISTORY_DONE), ("b", 7, EDIT), ("c", 8, feed.HISTORY_DONE)], "volume string, id long, flags long")
    assert {tuple(r) for r in feed.history_by_volume(events, events).collect()} == {("a", True, 9, False), ("b", False, 0, False), ("c", True, 8, False)}
    assert all(r.finished for r in feed.history_by_volume(events, events.where("volume <> 'b'")).collect())


def test_checkpoint_in_the_shared_folder_follows_a_feed(spark, tmp_path):
    """What a live feed has applied, per volume; cursors only rise, and another driver reads them."""
    template = Checkpoint("db", {"roots": ["/"]}, 0.0, [VolumeCursor("v1", "j", 3), VolumeCursor("v2", "k", 0)])
    file = CheckpointFile(f"{tmp_path}/shared/checkpoint.json", spark)
    assert file.load() is None and file.follow(template, {"v1": 40}, 10.0) and not file.follow(template, {"v1": 12}, 20.0)
    assert file.follow(template, {"v1": 41, "v2": 7, "other": 1}, 30.0)
    found = CheckpointFile(f"{tmp_path}/shared/checkpoint.json", spark).load()
    assert [(v.identity, v.id) for v in found.volumes] == [("v1", 41), ("v2", 7)] and found.saved_at == 30.0
    assert found.valid("db", {"roots": ["/"]}, [], [VolumeCursor("v1", "j", 50), VolumeCursor("v2", "k", 7)], 40.0)
