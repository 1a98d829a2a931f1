"""All registered queries of the catalog engine, each beside an independent SQL form for DuckDB."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import highlight
from ..operators import frontier, hierarchy, mutate, reconcile, tokens, volumes
from ..operators.tokens import TokenIndex
from ..sources import adapters, journal
from ..sources.scopes import Scope
from ..storage import new_folder, save
from ..store import CatalogStore
from ..streaming import feed, live
from . import search as engine
from .search import Catalog, Request

FLAGSHIP = "bool_dnf"
#: The day that relative dates count from.
NOW = datetime(2001, 8, 1, 12, tzinfo=timezone.utc)

#: Added to ids of rows that come from elsewhere.
_NEW_ID = 10**12

_catalogs: dict[tuple, Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One catalog per application and input: it is written, and its folders' paths are computed, once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        _catalogs[key] = Catalog.stored(adapters.entries(spark, sf_dir), source=sf_dir)
    return _catalogs[key]


_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}
_ROW = "id, name, is_dir, size, modified"
_PAGE = "id, path, name, is_dir, size, modified, kind"


def _add(name: str, query, sql: str | None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def _matching(name: str, where: str, **request) -> None:
    """All matches of a request against a WHERE clause over e."""
    wanted = Request(now=NOW, **request)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine.matches(catalog(spark, sf_dir), wanted).select("id", "name", "is_dir", "size", "modified")

    _add(name, query, f"{adapters.ORACLE} SELECT {_ROW} FROM e WHERE name <> '' AND ({where})")


def _page(name: str, where: str, order: str, limit: int = 200, offset: int = 0, **request) -> None:
    """A page with its ranks."""
    wanted = Request(now=NOW, limit=limit, offset=offset, **request)
    _add(
        name,
        lambda spark, sf_dir: engine.search(catalog(spark, sf_dir), wanted),
        f"{adapters.ORACLE} SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS rank, {_PAGE} FROM e WHERE name <> '' AND ({where})) WHERE rank > {offset} AND rank <= {offset + limit}",
    )


def _plain(name: str, build, sql: str | None) -> None:
    """A query that is a function of the catalog."""
    _add(name, lambda spark, sf_dir: build(catalog(spark, sf_dir)), sql)


_NAME = "lower(name), id"
_HAS_RING = "contains(lower(name), 'ring')"
_WORD_RING = r"regexp_matches(lower(name), '(^|[^\p{L}\p{N}_])ring([^\p{L}\p{N}_]|$)')"


def _file(condition: str) -> str:
    return f"(NOT is_dir AND {condition})"


def _ext(*values: str) -> str:
    return _file(f"lower(ext) IN ({', '.join(repr(v) for v in values)})")


def _day(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}') // 1000000"


def _patched_tokens(c: Catalog) -> DataFrame:
    """A phrase in the index after a change set: every 997th id renamed, every 991st gone."""
    after = c.entries.where("id % 991 <> 0").withColumn("name", F.when(F.expr("id % 997 = 0"), F.concat(F.lit("Ring-"), "name")).otherwise(F.col("name")))
    index = c.tokens.patch(c.entries.where("id % 991 = 0 or id % 997 = 0").select("id"), after.where("id % 997 = 0"))
    index = index or TokenIndex.build(after)
    found = index.ids("ring.blue", prefix=False).union(index.ids("ring.red", prefix=False)).distinct()
    return after.join(found, "id", "left_semi").select("id", "name")


#: Events are replayed from here on.
_SINCE = 137


def _replayed(spark: SparkSession, sf_dir: str, roots: list[str]) -> DataFrame:
    """The feed's events as a journal, replayed behind a cursor through the stream until its flush at the end: all that was applied."""
    folder = new_folder(spark, "journal")
    events = adapters.feed(spark, sf_dir).select(F.lit("main").alias("volume"), "id", "path", "flags")
    last = events.agg(F.max("id")).first()[0] or 0
    ask = spark.createDataFrame([("main", last + 1, "/", live.FLUSH)], journal.SCHEMA)
    journal.write_events(events.unionByName(ask), folder)
    applied = new_folder(spark, "applied")
    # nothing is due before the flush that is asked for
    query = live.start(journal.stream(spark, folder, {"main": _SINCE}), dict.fromkeys(roots, "main"), lambda df, batch: df.write.parquet(f"{applied}/batch={batch}"), new_folder(spark, "feed"), once=True, debounce=3600.0)
    query.awaitTermination()
    schema = "volume string, root string, path string, scope int, first_id long, id long, batch long"
    return spark.read.schema(schema).parquet(applied).select("path", "scope", "first_id", "id")


def _patched_store(c: Catalog) -> CatalogStore:
    """A stored catalog and one patch on it: every 997th file renamed, every 991st gone, every 983rd there once more."""
    store = CatalogStore(c.entries.sparkSession, new_folder(c.entries.sparkSession, "store"))
    with store.transaction() as t:
        t.append(c.entries)
    files = c.entries.where("not is_dir")
    renamed = files.where("id % 997 = 0 and id % 991 <> 0").withColumn("name", F.concat(F.lit("Ring-"), "name"))
    copied = files.where("id % 983 = 0").withColumn("name", F.concat(F.lit("again~"), "name")).withColumn("id", F.col("id") + _NEW_ID)
    with store.transaction() as t:
        t.patch(files.where("id % 997 = 0 or id % 991 = 0").select("id").unionByName(copied.select("id")), renamed.unionByName(copied))
    return store


def _compacted(c: Catalog) -> DataFrame:
    store = _patched_store(c)
    store.compact(dead_bytes=1, dead_share=0.0)
    return store.catalog().entries


def _register() -> None:
    # scans and aggregates
    _plain("scan_count", lambda c: c.statistics(), f"{adapters.ORACLE} SELECT count(*) AS n_rows, count(*) FILTER (is_dir) AS n_dirs, count(*) FILTER (NOT is_dir) AS n_files, CAST(sum(strlen(name)) AS BIGINT) AS name_bytes, max(id) + 1 AS next_id FROM entries")
    _plain("full_scan", lambda c: c.entries.where("name <> ''"), f"{adapters.ORACLE} SELECT id, parent, name, is_dir, size, modified FROM entries WHERE name <> ''")
    _plain("folder_scan", lambda c: hierarchy.folders(c.entries), f"{adapters.ORACLE} SELECT id, parent, name, is_dir, size, modified FROM entries WHERE is_dir OR parent = 0")
    _plain("distinct_names", lambda c: c.entries.groupBy("name").agg(F.count("*").alias("n")), f"{adapters.ORACLE} SELECT name, count(*) AS n FROM entries GROUP BY name")
    _plain("children_scan", lambda c: hierarchy.children(c.entries, 100), f"{adapters.ORACLE} SELECT id, parent, name, is_dir, size, modified FROM entries WHERE parent = 100")
    _plain("child_folders", lambda c: hierarchy.child_folders(c.entries, 10), f"{adapters.ORACLE} SELECT id, parent, name, is_dir, size, modified FROM entries WHERE parent = 10 AND is_dir")
    _plain("point_lookup", lambda c: hierarchy.child(c.entries, _values(c, "(10L, 'NATION_0'), (10L, 'missing'), (1L, 'ASIA')", "parent, name")).select("id", "parent", "name"), f"{adapters.ORACLE} SELECT id, parent, name FROM entries WHERE (parent, name) IN ((10, 'NATION_0'), (1, 'ASIA'))")
    # every id, every parent's id once for each child, and 0, which no entry has
    _plain("fetch_ids", lambda c: hierarchy.fetch(c.entries, c.entries.select(F.explode(F.array("id", "parent")).alias("id"))), f"{adapters.ORACLE} SELECT x.id, x.parent, x.name, x.is_dir, x.size, x.modified FROM entries x JOIN (SELECT id FROM entries UNION SELECT parent FROM entries) w ON w.id = x.id")

    # terms
    _matching("literal_ci", _HAS_RING, text="ring")
    _matching("literal_cs", "contains(name, 'PNG')", text="PNG", match_case=True)
    _page("bool_dnf", f"({_HAS_RING} AND NOT contains(lower(name), 'red')) OR contains(lower(name), 'gear')", _NAME, limit=20, text="ring !red | gear")
    _matching("empty_group_matches_all", "true", text="ring |")
    _matching("quoted_phrase", "contains(lower(name), 'red ring')", text='"red ring"')
    _matching("wildcard_star", r"regexp_matches(lower(name), '^.*\.png$')", text="*.png")
    _matching("wildcard_qmark", r"regexp_matches(lower(name), '^.*-.\.csv$')", text="*-?.csv")
    _matching("whole_word", _WORD_RING, text="ring", whole_word=True)
    _plain("token_match", lambda c: c.tokens.match(c.entries, "ring", prefix=False).select(*_ROW.split(", ")), rf"{adapters.ORACLE} SELECT {_ROW} FROM e WHERE regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])ring([^\p{{L}}\p{{N}}]|$)')")
    _plain("token_phrase", lambda c: tokens.token_match(c.entries, "red.ring").select(*_ROW.split(", ")), rf"{adapters.ORACLE} SELECT {_ROW} FROM e WHERE regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])red[^\p{{L}}\p{{N}}]+ring([^\p{{L}}\p{{N}}]|$)')")
    _plain("token_prefix_phrase", lambda c: c.tokens.match(c.entries, "red.ri").select(*_ROW.split(", ")), rf"{adapters.ORACLE} SELECT {_ROW} FROM e WHERE regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])red[^\p{{L}}\p{{N}}]+ri')")
    _plain("token_prefix_all", lambda c: c.tokens.match(c.entries, "gea bl").select(*_ROW.split(", ")), rf"{adapters.ORACLE} SELECT {_ROW} FROM e WHERE regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])gea') AND regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])bl')")
    _plain("token_patched", _patched_tokens, rf"{adapters.ORACLE}, n AS (SELECT id, CASE WHEN id % 997 = 0 THEN 'Ring-' || name ELSE name END AS name FROM entries WHERE id % 991 <> 0) SELECT id, name FROM n WHERE regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}])ring[^\p{{L}}\p{{N}}]+(blue|red)([^\p{{L}}\p{{N}}]|$)')")
    _matching("regex_name", r"regexp_matches(name, '(?i)^red.*\.(png|heic)$')", text=r"^red.*\.(png|heic)$", use_regex=True)
    _matching("regex_cs", r"regexp_matches(name, '\.PNG$')", text=r"\.PNG$", use_regex=True, match_case=True)
    _matching("regex_path", r"regexp_matches(path, '(?i)^/ASIA/.*\.pdf$')", text=r"^/ASIA/.*\.pdf$", use_regex=True, match_path=True)
    _matching("path_term", f"contains(lower(path), '/asia') AND {_HAS_RING}", text="/asia ring")
    _matching("path_wildcard", r"regexp_matches(lower(path), '^.*/nation_2/.*\.pdf$')", text="*/nation_2/*.pdf")
    _matching("path_match", "contains(lower(path), 'nation_3') AND contains(lower(path), 'gear')", text="nation_3 gear", match_path=True)
    _matching("path_prefix", "starts_with(lower(path), '/asia/nation_2/') AND contains(lower(name), 'gear')", text="/ASIA/NATION_2/ gear")
    # filters
    _matching("ext_filter", _ext("pdf", "txt"), text="ext:pdf;txt")
    _matching("type_image", _ext("png", "heic"), text="type:image")
    _matching("type_alias", _ext("mp3"), text="type:music")
    _matching("not_ext", f"NOT {_ext('zip')}", text="!ext:zip")
    _matching("size_cmp", _file("size > 5000000"), text="size:>5MB")
    _matching("size_range", _file("size BETWEEN 1048576 AND 4194304"), text="size:1MiB..4MiB")
    _matching("size_ne", _file("size <> 0"), text="size:!=0")
    _matching("size_le_negated", f"NOT {_file('size <= 2000000')}", text="!size:<=2mb")
    _matching("size_open_range", _file("size >= 9000000"), text="size:9mb..")
    d = f"modified >= {_day('2001-01-10')} AND modified < {_day('2001-01-11')}"
    _matching("dm_day", d, text="dm:2001-01-10")
    _matching("dm_ne", f"NOT ({d})", text="dm:!=2001-01-10")
    _matching("dm_range", f"modified >= {_day('2000-12-01')} AND modified < {_day('2001-01-01')}", text="dm:2000-12-01..2000-12-31")
    _matching("dm_le", f"modified < {_day('1999-01-02')}", text="datemodified:<=1999-01-01")
    _matching("dm_gt", f"modified >= {_day('2001-06-02')}", text="dm:>2001-06-01")
    for name, low, high, closed in (
        ("today", "2001-08-01", "2001-08-02", 0), ("yesterday", "2001-07-31", "2001-08-01", 0), ("thisweek", "2001-07-30", "2001-08-06", 0), ("lastweek", "2001-07-23", "2001-07-30", 0), ("thismonth", "2001-08-01", "2001-09-01", 0),
        ("lastmonth", "2001-07-01", "2001-08-01", 0), ("thisyear", "2001-01-01", "2002-01-01", 0), ("lastyear", "2000-01-01", "2001-01-01", 0), ("pastweek", "2001-07-25 12:00:00", "2001-08-01 12:00:00", 1), ("pastmonth", "2001-07-01 12:00:00", "2001-08-01 12:00:00", 1),
        ("pastyear", "2000-08-01 12:00:00", "2001-08-01 12:00:00", 1),
    ):
        _matching(f"dm_relative_{name}", f"modified >= {_day(low)} AND modified {'<=' if closed else '<'} {_day(high)}", text=f"dm:{name}")
    _matching("kind_files", f"NOT is_dir AND {_HAS_RING}", text="ring", kind="files")
    _matching("kind_folders", "is_dir AND contains(lower(name), '7')", text="7", kind="folders")
    _matching("hidden_off", f"NOT starts_with(name, '.') AND {_HAS_RING}", text="ring", include_hidden=False)
    _matching("file_value", "NOT is_dir AND contains(lower(name), 'bolt')", text="file:bolt")
    _matching("folder_value", "is_dir AND contains(lower(name), 'order-1')", text="folder:order-1")
    _matching("not_folder", f"NOT is_dir AND {_HAS_RING}", text="!folder: ring")
    # folders
    asia, asia_pdf = "starts_with(lower(path), '/asia/')", f"starts_with(lower(path), '/asia/') AND {_ext('pdf')}"
    _matching("in_scope", asia_pdf, text="in:/ASIA ext:pdf")
    _matching("infolder_scope", asia_pdf, text="infolder:/asia ext:pdf")
    _matching("in_scope_cs", f"starts_with(path, '/ASIA/') AND {_ext('pdf')}", text="in:/ASIA ext:pdf", match_case=True)
    _matching("parent_scope", "regexp_matches(lower(path), '^/asia/[^/]+$')", text="parent:/ASIA")
    _matching("not_in_scope", f"{_ext('pdf')} AND NOT {asia}", text="ext:pdf !in:/ASIA")
    _matching("multi_scope", f"({asia} OR starts_with(lower(path), '/europe/')) AND {_ext('mp3')}", text="", sort_empty=True, scope=Scope("two", ("/ASIA", "/ASIA/NATION_2", "/EUROPE"), "ext:mp3"))
    _matching("missing_scope_or", _ext("png"), text="in:/Missing | ext:png")
    _matching("correlated_or", f"(contains(lower(name), 'red') AND {_ext('pdf')}) OR (contains(lower(name), 'gear') AND {_ext('png')})", text="red ext:pdf | gear ext:png")
    _matching("saved_scope", f"({_HAS_RING} OR contains(lower(name), 'gear')) AND {asia} AND (({_ext('pdf')} AND NOT contains(lower(name), 'red')) OR ({_ext('txt')} AND {_file('size > 2000000')}))", text="ring | gear", scope=Scope("s", ("/ASIA",), "ext:pdf !red | ext:txt size:>2MB"))
    _matching("saved_scope_regex", rf"regexp_matches(name, '(?i)^(red|blue)') AND {asia} AND {_ext('csv')}", text="^(red|blue)", use_regex=True, scope=Scope("s", ("/ASIA",), "ext:csv"))
    # orders and pages
    keys = {"name": "lower(name)", "path": "lower(path)", "size": "size", "kind": "is_dir", "modified": "modified"}
    for key, column in keys.items():
        for direction in ("asc", "desc"):
            order = f"{column} {direction}, " + ("id" if key == "name" else _NAME)
            _page(f"sort_{key}_{direction}", _HAS_RING + " OR is_dir", order, limit=500, text="ring | folder:", sort=key, ascending=direction == "asc")
    _page("page_offset", _HAS_RING, _NAME, limit=47, offset=150, text="ring")
    _plain("page_total", lambda c: engine.total(c, Request("ring", now=NOW, limit=1)), f"{adapters.ORACLE} SELECT count(*) AS total FROM e WHERE {_HAS_RING}")
    _page("recent_items", "true", "modified DESC, id DESC", text="  ")
    _page("recent_scoped", f"{asia} AND {_file('size >= 3000000')}", "modified DESC, id DESC", text="", scope=Scope("r", ("/ASIA",), "size:>=3000000"))
    _page("recent_scoped_terms", f"{asia} AND {_ext('pdf')}", f"modified DESC, {_NAME}", text="", scope=Scope("r", ("/ASIA",), "ext:pdf"))
    _page("sorted_empty", "true", f"size DESC, {_NAME}", text="", sort_empty=True, sort="size", ascending=False)
    _plain("joined_lines", lambda c: engine.joined_names(engine.search(c, Request("gear", now=NOW, limit=50))), f"{adapters.ORACLE} SELECT string_agg(path, chr(10) ORDER BY r) AS lines FROM (SELECT path, row_number() OVER (ORDER BY {_NAME}) AS r FROM e WHERE contains(lower(name), 'gear')) WHERE r <= 50")
    # hierarchy
    _plain("materialize_paths", lambda c: hierarchy.with_paths(c.entries, c.paths).select("id", "path"), f"{adapters.ORACLE} SELECT id, path FROM e")
    _plain("ancestors", lambda c: hierarchy.ancestor_ids(c.entries, c.paths, c.entries.where("not is_dir").select("id")), f"""{adapters.ORACLE}, up AS (SELECT DISTINCT parent AS id FROM entries WHERE NOT is_dir UNION SELECT x.parent FROM up JOIN entries x ON x.id = up.id) SELECT id FROM up WHERE id > 0""")
    _plain("descendants", lambda c: hierarchy.descendants(c.entries, c.paths, c.entries.where("id in (10, 102)").select("id")), f"""{adapters.ORACLE}, down AS (SELECT id FROM entries WHERE id IN (10, 102) UNION SELECT x.id FROM down JOIN entries x ON x.parent = down.id) SELECT id FROM down""")
    _plain("path_lookup", lambda c: hierarchy.lookup(c.entries, c.paths, _values(c, "('/ASIA'), ('/'), ('/ASIA/none')", "path")).select("id", "path"), f"{adapters.ORACLE} SELECT id, path FROM e WHERE path IN ('/ASIA', '/', '/ASIA/none')")
    # every file where it is and below a name that is not there, and something outside the tree
    _plain("deepest_known", lambda c: hierarchy.deepest_known(c.entries, c.paths, _wanted(c)).select("path", "owner"), f"""{adapters.ORACLE}, w AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM e WHERE NOT is_dir)
        SELECT path, folder AS owner FROM w UNION ALL SELECT folder || '/not-there/at all' || regexp_extract(path, '/[^/]*$'), folder FROM w UNION ALL SELECT '/nowhere/x', '/'""")
    _plain("kind_text", lambda c: c.entries.groupBy(schema.kind(F.col("name"), F.col("is_dir")).alias("kind")).agg(F.count("*").alias("n")), f"{adapters.ORACLE} SELECT kind, count(*) AS n FROM e GROUP BY kind")
    _plain("highlight_counts", lambda c: c.entries.where("name <> ''").select("id", highlight.spans_count(F.col("name"), Request("re*ing | !bolt")).alias("spans")), f"{adapters.ORACLE} SELECT id, CAST(len(regexp_extract_all(lower(name), 're')) + len(regexp_extract_all(lower(name), 'ing')) AS BIGINT) AS spans FROM e WHERE name <> ''")
    _plain("minimal_cover", lambda c: hierarchy.minimal_cover(c.paths.where("path is not null and path <> '/'").select("path")), f"{adapters.ORACLE}, s AS (SELECT DISTINCT CASE WHEN path = '' THEN '/' ELSE path END AS path FROM folder WHERE path <> ''), parts AS (SELECT path, unnest(generate_series(2, len(string_split(path, '/')) - 1)) AS n FROM s), up AS (SELECT path, array_to_string(string_split(path, '/')[1:n], '/') AS above FROM parts) SELECT path FROM s WHERE path NOT IN (SELECT up.path FROM up JOIN s ON s.path = up.above) AND NOT EXISTS (SELECT 1 FROM s t WHERE t.path = '/' AND s.path <> '/')")
    _plain("volume_owner", lambda c: hierarchy.owner(c.paths.where("path is not null").select("path"), _values(c, "('/'), ('/ASIA'), ('/ASIA/NATION_2'), ('/EUR')", "holder")), f"{adapters.ORACLE} SELECT p AS path, CASE WHEN p = '/ASIA/NATION_2' OR starts_with(p, '/ASIA/NATION_2/') THEN '/ASIA/NATION_2' WHEN p = '/ASIA' OR starts_with(p, '/ASIA/') THEN '/ASIA' ELSE '/' END AS owner FROM (SELECT CASE WHEN path = '' THEN '/' ELSE path END AS p FROM folder)")
    shares = "concat('smb://', replace(s_name, '#', ''), ':secret@Server-', s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN ':445' ELSE '' END, '/Team/', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END)"
    _add("share_identity", lambda spark, sf: volumes.share_identities(adapters.read(spark, sf, "supplier").selectExpr(f"{shares} AS url")), f"SELECT {shares} AS url, 'share:smbfs:server-' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ':445' ELSE '' END || '/Team/' || s_suppkey AS identity FROM supplier")
    _add("resolve_locations", _locations, "SELECT '/Volumes/' || c_name || '/data' AS path, 'uuid:' || c_custkey AS identity, CASE WHEN c_custkey % 11 = 0 THEN 'offline' WHEN c_custkey % 13 = 0 THEN 'ambiguous' WHEN c_custkey % 17 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'moved' ELSE 'available' END AS status, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '/Volumes/' || c_name || ' 1/data' ELSE '/Volumes/' || c_name || '/data' END AS target FROM customer")
    _plain("volume_paths", _volume_paths, f"""{adapters.ORACLE} SELECT path, volume, CASE volume WHEN 'root' THEN path WHEN 'asia' THEN coalesce(nullif(substr(path, 6), ''), '/') ELSE coalesce(nullif(substr(path, 15), ''), '/') END AS relative,
        CASE volume WHEN 'root' THEN path WHEN 'asia' THEN '/mnt/asia' || substr(path, 6) ELSE '/mnt/two' || substr(path, 15) END AS now
        FROM (SELECT path, CASE WHEN path = '/ASIA/NATION_2' OR starts_with(path, '/ASIA/NATION_2/') THEN 'two' WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN 'asia' ELSE 'root' END AS volume FROM e)""")
    # changes
    copy = "SELECT id, parent, name, is_dir, size, modified FROM entries"
    everything = f"{adapters.ORACLE} {copy}"
    _plain("upsert_noop", lambda c: mutate.upsert(c.entries, c.entries), f"{adapters.ORACLE} {copy.replace('modified FROM', "modified, 'none' AS change FROM")}")
    changed = "NOT is_dir AND id % 13 = 0"
    _plain("upsert_replace", lambda c: mutate.upsert(c.entries, _perturbed(c)), f"""{adapters.ORACLE} SELECT CASE WHEN {changed} THEN id + {_NEW_ID} ELSE id END AS id, parent, name, is_dir, CASE WHEN {changed} THEN size + 1 ELSE size END AS size, modified, CASE WHEN {changed} THEN 'update' ELSE 'none' END AS change FROM entries
        UNION ALL SELECT id + {2 * _NEW_ID}, parent, 'inserted~' || name, is_dir, size + CASE WHEN {changed} THEN 1 ELSE 0 END, modified, 'insert' FROM entries WHERE NOT is_dir AND id % 17 = 0""")
    _plain("upsert_last_wins", lambda c: mutate.upsert(c.entries.limit(0), _duplicates(c), "seq").select("name", "size"), "SELECT name, size FROM (SELECT 'line-' || l_orderkey || '-' || l_linenumber AS name, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, round(l_extendedprice * 100) DESC) AS r FROM lineitem) WHERE r = 1")
    _plain("allocate_ids", lambda c: mutate.allocate_ids(c.entries.select("name", F.col("id").alias("k")), c.entries, ["k"]).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("low"), F.max("id").alias("high")), f"{adapters.ORACLE} SELECT count(*) AS n, count(*) AS n_ids, max(id) + 1 AS low, max(id) + count(*) AS high FROM entries")
    gone = "WITH_DOWN AS (SELECT id FROM entries WHERE id = 101 UNION SELECT x.id FROM WITH_DOWN w JOIN entries x ON x.parent = w.id)"
    _plain("delete_subtree", lambda c: mutate.delete_subtree(c.entries, _values(c, "(101L)", "id"), paths=c.paths), f"{adapters.ORACLE}, {gone} {copy} WHERE id NOT IN (SELECT id FROM WITH_DOWN)")
    grown, lost = "NOT is_dir AND size >= 3000000", "NOT is_dir AND size < 200000"
    _plain("snapshot_changes", lambda c: mutate.changes(c.entries, _next(c, grown, lost)), f"""{adapters.ORACLE} SELECT id, CASE WHEN {grown} THEN 'update' ELSE 'delete' END AS change FROM entries WHERE ({grown}) OR ({lost})
        UNION ALL SELECT id + {_NEW_ID}, 'insert' FROM entries WHERE is_dir""")
    _plain("delete_ids", lambda c: mutate.delete_ids(c.entries, c.entries.where("id % 3 = 0").select("id")), f"{everything} WHERE id % 3 <> 0")
    keep = "kept AS (SELECT id FROM entries WHERE id = 103 UNION SELECT x.id FROM kept w JOIN entries x ON x.parent = w.id), above AS (SELECT parent AS id FROM entries WHERE id = 103 UNION SELECT x.parent FROM above a JOIN entries x ON x.id = a.id)"
    _plain("clear_preserving", lambda c: mutate.clear(c.entries, _values(c, "(103L)", "id"), c.paths), f"{adapters.ORACLE}, {keep} {copy} WHERE id IN (SELECT id FROM kept UNION SELECT id FROM above)")
    _plain("delete_keeping", lambda c: mutate.delete_subtree(c.entries, _values(c, "(1L)", "id"), _values(c, "(103L)", "id"), c.paths), f"{adapters.ORACLE}, {keep} {copy} WHERE id IN (SELECT id FROM kept UNION SELECT id FROM above)")
    _plain("sync_roots", lambda c: mutate.sync_roots(c.entries, ["/ASIA", "/EUROPE/", "/ASIA/NATION_2", "relative", ""], c.paths), f"{adapters.ORACLE} SELECT id, CASE WHEN path IN ('/ASIA', '/EUROPE') THEN 0 ELSE parent END AS parent, CASE WHEN path IN ('/ASIA', '/EUROPE') THEN path ELSE name END AS name, is_dir, size, modified FROM e WHERE path IN ('/ASIA', '/EUROPE') OR starts_with(path, '/ASIA/') OR starts_with(path, '/EUROPE/')")
    _plain("merge_trees", _merged_copy, f"{adapters.ORACLE} {copy} UNION ALL SELECT id + {_NEW_ID}, parent, 'extra~' || name, is_dir, size, modified FROM entries WHERE NOT is_dir AND id % 7 = 0")
    _plain("relocate", lambda c: hierarchy.with_paths(m := mutate.relocate(c.entries, "/ASIA", "/EUROPE/moved", paths=c.paths), hierarchy.folder_paths(m)).select("id", "path"), f"{adapters.ORACLE} SELECT id, CASE WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN '/EUROPE/moved' || substr(path, 6) ELSE path END AS path FROM e")
    _plain("ensure_folders", lambda c: hierarchy.folder_paths(mutate.ensure_folders(c.entries, _values(c, "('/ASIA/x/y'), ('/ASIA/x'), ('relative')", "path"), c.paths)).select("path"), f"{adapters.ORACLE} SELECT CASE WHEN path = '' THEN '/' ELSE path END AS path FROM folder UNION ALL SELECT '/ASIA/x' UNION ALL SELECT '/ASIA/x/y'")
    patched = f"""{adapters.ORACLE}, p AS (SELECT id, parent, CASE WHEN NOT is_dir AND id % 997 = 0 THEN 'Ring-' || name ELSE name END AS name, is_dir, size, modified, kind, CASE WHEN NOT is_dir AND id % 997 = 0 THEN left(path, length(path) - length(name)) || 'Ring-' || name ELSE path END AS path FROM e WHERE is_dir OR id % 991 <> 0
        UNION ALL SELECT id + {_NEW_ID}, parent, 'again~' || name, is_dir, size, modified, kind, left(path, length(path) - length(name)) || 'again~' || name FROM e WHERE NOT is_dir AND id % 983 = 0)"""
    by_size = "size DESC, lower(name), id"
    _plain("patched_search", lambda c: engine.search(_patched_store(c).catalog(), Request("ring", sort="size", ascending=False, limit=300, now=NOW)), f"{patched} SELECT row_number() OVER (ORDER BY {by_size}) AS rank, {_PAGE} FROM p WHERE {_HAS_RING} QUALIFY rank <= 300")
    _plain("compacted_catalog", _compacted, f"{patched} SELECT id, parent, name, is_dir, size, modified FROM p")
    # reconciling
    seen = "CASE WHEN is_dir THEN 'unchanged' WHEN id % 11 = 0 THEN 'delete' WHEN id % 13 = 0 THEN 'update' ELSE 'unchanged' END"
    _plain("reconcile_diff", lambda c: _difference(c).select("parent", "name", "change", "size", "new_size"), f"{adapters.ORACLE}, x AS (SELECT *, {seen} AS change FROM entries) SELECT parent, name, change, size, CASE change WHEN 'delete' THEN NULL WHEN 'update' THEN size + 1 ELSE size END AS new_size FROM x UNION ALL SELECT parent, 'inserted~' || name, 'insert', NULL, size + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END FROM entries WHERE NOT is_dir AND id % 17 = 0")
    _plain("reconcile_counters", lambda c: reconcile.counters(_difference(c)), f"{adapters.ORACLE}, x AS (SELECT is_dir, CASE WHEN is_dir THEN 'unchanged' WHEN id % 11 = 0 THEN 'delete' WHEN id % 13 = 0 THEN 'update' ELSE 'unchanged' END AS change FROM entries UNION ALL SELECT false, 'insert' FROM entries WHERE NOT is_dir AND id % 17 = 0) SELECT count(*) FILTER (change <> 'delete') AS scanned, count(*) FILTER (change IN ('insert', 'update')) AS written, count(*) FILTER (change = 'delete') AS deleted, count(*) FILTER (is_dir AND change <> 'delete') AS dirs, count(*) FILTER (NOT is_dir AND change <> 'delete') AS files, bool_or(change <> 'unchanged') AS changed FROM x")
    _plain("reconcile_frontier", _frontier, rf"""{adapters.ORACLE}, x AS (SELECT id, parent, regexp_replace(path, '/[^/]*$', '') AS directory, path, name, is_dir, size, modified FROM e WHERE parent > 0),
        due AS (SELECT id FROM x WHERE NOT starts_with(path, '/EUROPE') AND id BETWEEN 1000000 AND 99999999 AND id % 5 = 0),
        files AS (SELECT f.* FROM x f JOIN x o ON f.parent = o.id JOIN due ON o.parent = due.id WHERE NOT f.is_dir)
        SELECT directory, name, CASE WHEN id % 11 = 0 THEN 'delete' ELSE 'update' END AS change, size, CASE WHEN id % 11 <> 0 THEN size + 1 END AS new_size FROM files WHERE id % 11 = 0 OR id % 13 = 0
        UNION ALL SELECT path, 'fresh', 'insert', NULL, 0 FROM x WHERE id BETWEEN 100 AND 999 AND id % 3 = 0 AND NOT starts_with(path, '/EUROPE')
        UNION ALL SELECT path || '/fresh', 'inside.txt', 'insert', NULL, 3 FROM x WHERE id BETWEEN 100 AND 999 AND id % 3 = 0 AND NOT starts_with(path, '/EUROPE')
        UNION ALL SELECT CASE WHEN directory = '' THEN '/' ELSE directory END, name, 'delete', size, NULL FROM x WHERE path = '/EUROPE' OR starts_with(path, '/EUROPE/')""")
    # ids of inserted rows are fresh ones; the others stay
    _plain("reconcile_apply", lambda c: reconcile.apply_diff(c.entries, _difference(c), c.paths).select(F.when(~F.col("name").startswith("inserted~"), F.col("id")).alias("id"), "parent", "name", "is_dir", "size", "modified"), f"{adapters.ORACLE} SELECT id, parent, name, is_dir, size + CASE WHEN {changed} THEN 1 ELSE 0 END AS size, modified FROM entries WHERE is_dir OR id % 11 <> 0 UNION ALL SELECT NULL, parent, 'inserted~' || name, is_dir, size + CASE WHEN {changed} THEN 1 ELSE 0 END, modified FROM entries WHERE NOT is_dir AND id % 17 = 0")
    _plain("point_check", _point_check, f"{adapters.ORACLE} SELECT path, CASE WHEN is_dir THEN 'directory' WHEN id % 11 = 0 THEN 'delete' WHEN id % 13 = 0 THEN 'update' ELSE 'none' END AS action FROM e UNION ALL SELECT regexp_replace(path, '/([^/]*)$', '/inserted~\\1'), 'insert' FROM e WHERE NOT is_dir AND id % 17 = 0 UNION ALL SELECT '/nowhere' || path, 'parent' FROM e WHERE NOT is_dir AND id % 19 = 0")
    config = reconcile.ScanConfig(("/",), ("BOLT",), ("*.tmp", "red?gear*"), ("/EUROPE",), ("NATION_2",))
    _plain("exclude_names", lambda c: c.entries.where(~reconcile.excluded_name(F.col("name"), F.col("is_dir"), config)).select("id"), f"{adapters.ORACLE} SELECT id FROM e WHERE NOT (contains(lower(name), 'bolt') OR regexp_matches(lower(name), '^red.gear') OR ends_with(lower(name), '.tmp') OR (is_dir AND name = 'NATION_2'))")
    _plain("exclude_prefix", lambda c: hierarchy.with_paths(c.entries, c.paths).where(~reconcile.excluded_path(F.col("path"), config)).select("id"), f"{adapters.ORACLE} SELECT id FROM e WHERE NOT (path = '/EUROPE' OR starts_with(path, '/EUROPE/') OR contains(lower(path), 'bolt') OR regexp_matches(lower(path), '/red.gear[^/]*') OR contains(path || '/', '/NATION_2/'))")
    # the feed
    roots = ["/user-1", "/user-2", "/user-3/sub"]
    routed = f"""{adapters.FEED_ORACLE}, inside AS (SELECT *, (flags & 65536) <> 0 AND (flags & 131072) = 0 AS is_file, regexp_matches(path, '^/user-[12](/|$)') AS held FROM feed),
        routed AS (SELECT id, CASE WHEN is_file AND (flags & 256) <> 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS path, CASE WHEN (flags & 1) <> 0 OR ((flags & 131072) <> 0 AND (flags & 256) <> 0) THEN 2 WHEN is_file AND (flags & 256) = 0 THEN 0 ELSE 1 END AS scope FROM inside WHERE held
          UNION ALL SELECT id, '/user-3/sub', 2 FROM inside WHERE path = '/user-3')"""
    merged = f"""{routed}, pending AS (SELECT path, max(scope) AS scope, min(id) AS first_id, max(id) AS id FROM routed GROUP BY path),
        target AS (SELECT CASE WHEN f.path IS NOT NULL AND (f.scope = 2 OR (f.scope = 1 AND p.scope = 0)) THEN f.path ELSE p.path END AS path, CASE WHEN f.path IS NOT NULL AND (f.scope = 2 OR (f.scope = 1 AND p.scope = 0)) THEN 0 ELSE p.scope END AS scope, p.first_id, p.id
          FROM pending p LEFT JOIN pending f ON f.path = regexp_extract(p.path, '^(/user-[12])/', 1)),
        coalesced AS (SELECT path, max(scope) AS scope, min(first_id) AS first_id, max(id) AS id FROM target GROUP BY path)"""
    _add("event_routing", lambda spark, sf: feed.route(adapters.feed(spark, sf), roots), f"{routed} SELECT path, scope, id FROM routed")
    _add("event_coalesce", lambda spark, sf: feed.coalesce(feed.route(adapters.feed(spark, sf), roots), roots), f"{merged} SELECT path, scope, first_id, id FROM coalesced")
    behind = merged.replace("WHERE held", f"WHERE held AND id > {_SINCE}").replace("path = '/user-3'", f"path = '/user-3' AND id > {_SINCE}")
    _add("feed_replay", lambda spark, sf: _replayed(spark, sf, roots), f"{behind} SELECT path, scope, first_id, id FROM coalesced")
    _add("event_overflow", lambda spark, sf: feed.coalesce(feed.route(adapters.feed(spark, sf), roots), roots, 1), f"{merged} SELECT r AS path, 2 AS scope, min(first_id) AS first_id, max(id) AS id FROM coalesced, (VALUES ('/user-1'), ('/user-2'), ('/user-3/sub')) v(r) GROUP BY r")
    _add("event_cursor", _cursor, f"{adapters.FEED_ORACLE} SELECT coalesce(greatest(0, min(id) FILTER (id % 10 = 9 AND id > 1000) - 1), max(id), 0) AS cursor FROM feed")
    _add("event_flags", lambda spark, sf: adapters.feed(spark, sf).groupBy(feed.is_file_item(F.col("flags")).alias("is_file"), feed.changes_name(F.col("flags")).alias("renames"), feed.replaces_folder(F.col("flags")).alias("replaces"), feed.needs_recursive_scan(F.col("flags")).alias("deep")).agg(F.count("*").alias("n")), "SELECT event_type IN ('click', 'view', 'purchase') AS is_file, event_type = 'purchase' AS renames, event_type = 'signup' AS replaces, event_type = 'error' AS deep, count(*) AS n FROM events GROUP BY ALL")
    _add("event_history", lambda spark, sf: feed.history_done(adapters.feed(spark, sf).withColumn("flags", F.when(F.col("id") % 100 == 7, F.col("flags").bitwiseOR(F.lit(feed.HISTORY_DONE))).otherwise(F.col("flags")))), "SELECT count(*) FILTER (event_id % 100 = 7) > 0 AS done, coalesce(max(event_id) FILTER (event_id % 100 = 7), 0) AS id FROM events")
    _add("event_history_volumes", _history, "SELECT 'v' || user_id % 7 AS volume, count(*) FILTER (event_id % 50 = 7) > 0 AS done, coalesce(max(event_id) FILTER (event_id % 50 = 7), 0) AS id, bool_and(count(*) FILTER (event_id % 50 = 7) > 0) OVER () AS finished FROM events GROUP BY 1")


def _next(c: Catalog, grown: str, lost: str) -> DataFrame:
    """The entries without some, with others grown, and a copy of each folder."""
    kept = c.entries.where(f"NOT ({lost})").withColumn("size", F.when(F.expr(grown), F.col("size") + 1).otherwise(F.col("size")))
    return kept.unionByName(c.entries.where("is_dir").withColumn("id", F.col("id") + _NEW_ID))


def _values(c: Catalog, rows: str, columns: str) -> DataFrame:
    return c.entries.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def _perturbed(c: Catalog) -> DataFrame:
    """The files, every 13th one byte larger and under another id, and every 17th once more under another name."""
    files = c.entries.where("not is_dir")
    moved = F.col("id") % 13 == 0
    changed = files.withColumn("size", F.when(moved, F.col("size") + 1).otherwise(F.col("size"))).withColumn("old", F.col("id"))
    more = changed.where("old % 17 = 0").withColumn("name", F.concat(F.lit("inserted~"), "name")).withColumn("id", F.col("id") + 2 * _NEW_ID)
    return changed.withColumn("id", F.when(moved, F.col("id") + _NEW_ID).otherwise(F.col("id"))).unionByName(more).drop("old")


def _observed(c: Catalog) -> DataFrame:
    """What a scan finds after changes: every 11th file is gone."""
    return _perturbed(c).where(f"id % {_NEW_ID} % 11 <> 0 or name like 'inserted~%'").unionByName(c.entries.where("is_dir")).withColumn("modified", F.col("modified") + F.lit(0.25))


def _difference(c: Catalog) -> DataFrame:
    return reconcile.diff(c.entries, _observed(c))


def _point_check(c: Catalog) -> DataFrame:
    # paths are written once, all sides are read from them
    located = save(hierarchy.with_paths(c.entries, c.paths).drop("name"), "located", compression="zstd").withColumn("name", F.substring_index("path", "/", -1))
    named = F.when(F.col("name").startswith("inserted~"), schema.join_path(schema.parent_path(F.col("path")), F.col("name"))).otherwise(F.col("path"))
    stored, observed = located, _observed(Catalog(located)).withColumn("path", named)
    strays = stored.where("not is_dir and id % 19 = 0").withColumn("path", F.concat(F.lit("/nowhere"), "path"))
    changed = stored.select("path").unionByName(observed.select("path")).unionByName(strays.select("path"))
    seen = observed.select("path", "is_dir", "size", "modified").unionByName(strays.select("path", "is_dir", "size", F.col("modified").cast("double").alias("modified")))
    return reconcile.point_check(changed, stored, seen, c.paths.where("path is not null"))


def _frontier(c: Catalog) -> DataFrame:
    """Some customers due whole and some nations due alone, where customers lost files or are gone, and new folders with a file came."""
    stored = hierarchy.with_paths(c.entries.where("parent > 0"), c.paths)
    directory = schema.parent_path(F.col("path"))
    seen = stored.where("(is_dir or id % 11 <> 0)").withColumn("size", F.when(~F.col("is_dir") & (F.col("id") % 13 == 0), F.col("size") + 1).otherwise(F.col("size")))
    rows = seen.select(directory.alias("directory"), "name", "is_dir", "size", F.col("modified").cast("double").alias("modified"))
    nations = stored.where("id between 100 and 999")
    fresh = nations.select(F.col("path").alias("directory"), F.lit("fresh").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(1.5).alias("modified"))
    inside = nations.select(F.concat("path", F.lit("/fresh")).alias("directory"), F.lit("inside.txt").alias("name"), F.lit(False).alias("is_dir"), F.lit(3).cast("long").alias("size"), F.lit(2.5).alias("modified"))
    rows = save(rows.unionByName(fresh).unionByName(inside).withColumn("is_symlink", F.lit(False)).withColumn("failure", F.lit(None).cast("string")), "observed")
    due = stored.where("id between 1000000 and 99999999 and id % 5 = 0").select("path", F.lit(frontier.RECURSIVE).alias("scope")).unionByName(nations.where("id % 3 = 0").select("path", F.lit(1).alias("scope")))
    due = due.unionByName(_values(c, "('/EUROPE', 2)", "path, scope"))
    config = reconcile.ScanConfig(("/",), prefixes=("/EUROPE",))
    return frontier.reconcile(c.entries, c.paths, due, lambda level: rows.join(level, "directory", "left_semi"), config).select("directory", "name", "change", "size", "new_size")


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume for each customer: some are gone, mounted twice or elsewhere, or lack their folder."""
    rows = adapters.read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('uuid:', c_custkey) AS identity", "concat('/Volumes/', c_name) AS mount")
    bindings = rows.selectExpr("concat(mount, '/data') AS path", "identity", "'data' AS relative")
    now = rows.selectExpr("k", "identity", "CASE WHEN k % 7 = 0 THEN concat(mount, ' 1') ELSE mount END AS path").where("k % 11 <> 0")
    mounts = now.select("path", "identity").unionByName(now.where("k % 13 = 0").selectExpr("concat('/Mnt', path) AS path", "identity"))
    return volumes.resolve_locations(bindings, mounts, now.where("k % 17 <> 0").selectExpr("concat(path, '/data') AS path"))


def _volume_paths(c: Catalog) -> DataFrame:
    """Every path as its volume's own, and where it is once two volumes are mounted elsewhere."""
    mounts = _values(c, "('/', 'root'), ('/ASIA', 'asia'), ('/ASIA/NATION_2', 'two')", "path, volume")
    own = volumes.relative_paths(hierarchy.with_paths(c.entries, c.paths).select("path"), mounts)
    moved = volumes.absolute_paths(own.withColumnRenamed("path", "was"), _values(c, "('/', 'root'), ('/mnt/asia', 'asia'), ('/mnt/two', 'two')", "path, volume"))
    return moved.select(F.col("was").alias("path"), "volume", "relative", F.col("path").alias("now"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "events").selectExpr("concat('v', user_id % 7) AS volume", "event_id AS id", f"CASE WHEN event_id % 50 = 7 THEN {feed.HISTORY_DONE}L ELSE 0L END AS flags")
    return feed.history_by_volume(rows, rows.select("volume"))


def _wanted(c: Catalog) -> DataFrame:
    files = hierarchy.with_paths(c.entries.where("not is_dir"), c.paths).select("path")
    below = files.select(F.concat(schema.parent_path(F.col("path")), F.lit("/not-there/at all/"), schema.last_component(F.col("path"))).alias("path"))
    return files.unionByName(below).unionByName(_values(c, "('/nowhere/x')", "path"))


def _duplicates(c: Catalog) -> DataFrame:
    items = adapters.read(c.entries.sparkSession, c.source, "lineitem")
    size = F.round(F.col("l_extendedprice") * 100).cast("long")
    return items.select(F.lit(1).cast("long").alias("parent"), F.concat(F.lit("line-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("name"), F.lit(False).alias("is_dir"), size.alias("size"), F.lit(0).cast("long").alias("modified"), F.struct("l_partkey", "l_suppkey", size).alias("seq"))


def _merged_copy(c: Catalog) -> DataFrame:
    """A catalog merged with a copy of itself under other ids, in which every seventh file has another name: the catalog and those files."""
    moved = F.col("id") + _NEW_ID
    other = F.when(~F.col("is_dir") & (F.col("id") % 7 == 0), F.concat(F.lit("extra~"), "name")).otherwise(F.col("name"))
    copy = c.entries.select(moved.alias("id"), F.when(F.col("parent") == 0, F.lit(0).cast("long")).otherwise(F.col("parent") + _NEW_ID).alias("parent"), other.alias("name"), "is_dir", "size", "modified")
    return mutate.merge_trees(c.entries, copy, c.paths, c.paths.withColumn("id", moved).withColumn("chain", F.transform("chain", lambda i: i + _NEW_ID)))


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.feed(spark, sf_dir)
    waiting = (F.col("id") % 10 == 9) & (F.col("id") > 1000)
    return feed.cursor(rows.where(~waiting).select("id"), rows.where(waiting).select(F.col("id").alias("first_id")))


def queries() -> dict:
    if not _QUERIES:
        _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
