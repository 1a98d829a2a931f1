"""The test tables as catalogs: a five-level tree of orders, a tree of documents, and a feed of events."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import save, spread

#: Parts that are broadcast; more meet their items by a shuffle.
SMALL = 100_000

# Fixed values of the fixture: separators by part, extensions by part, id ranges by level.
SEPARATORS = (" ", "-", "_")
EXTENSIONS = ("pdf", "txt", "PNG", "zip", "swift", "csv", "Heic", "mp3")
REGION, NATION, CUSTOMER, ORDER, FILE = 10, 100, 1_000_000, 100_000_000, 1_000_000_000
# Event flags of the feed.
CREATED, MODIFIED, IS_FILE, IS_DIR, MUST_SCAN = 0x100, 0x1000, 0x10000, 0x20000, 0x1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts) -> F.Column:
    """Whole seconds, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))").cast("long")


def _folder(df: DataFrame, ident, parent, name, modified=None) -> DataFrame:
    return df.select(ident.cast("long").alias("id"), parent.cast("long").alias("parent"), name.alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), (F.lit(0) if modified is None else modified).cast("long").alias("modified"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filesystem root / region / nation / customer / order / line item (a file)."""
    col, lit = F.col, F.lit
    root = spark.range(1).select(lit(1).cast("long").alias("id"), lit(0).cast("long").alias("parent"), lit("").alias("name"), lit(True).alias("is_dir"), lit(0).cast("long").alias("size"), lit(0).cast("long").alias("modified"))
    regions = _folder(read(spark, sf_dir, "region"), col("r_regionkey") + REGION, lit(1), col("r_name"))
    nations = _folder(read(spark, sf_dir, "nation"), col("n_nationkey") + NATION, col("n_regionkey") + REGION, col("n_name"))
    customers = _folder(read(spark, sf_dir, "customer"), col("c_custkey") + CUSTOMER, col("c_nationkey") + NATION, col("c_name"))
    orders = _folder(read(spark, sf_dir, "orders"), col("o_orderkey") + ORDER, col("o_custkey") + CUSTOMER, F.concat(lit("order-"), col("o_orderkey").cast("string")), epoch("o_orderdate"))
    items = read(spark, sf_dir, "lineitem")
    # (order, line) repeats: the first by all other columns counts
    rest = [c for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
    keys = ["l_orderkey", "l_linenumber"]
    rows = items.count()
    first = spread(items.select(*keys, *rest), rows, *keys).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("f")).select(*keys, "f.*")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    first = first.select(*keys, "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    named = first.join(F.broadcast(parts), "l_partkey") if parts.count() <= SMALL else spread(first, rows, "l_partkey").join(spread(parts, rows, "l_partkey"), "l_partkey")
    separator = F.element_at(F.array(*map(lit, SEPARATORS)), (col("l_partkey") % 3 + 1).cast("int"))
    ext = F.element_at(F.array(*map(lit, EXTENSIONS)), (col("l_partkey") % 8 + 1).cast("int"))
    dot = F.when((col("l_returnflag") == "R") & (col("l_partkey") % 5 == 0), ".").otherwise("")
    name = F.concat(dot, F.replace(col("p_name"), lit(" "), separator), lit("-"), col("l_linenumber").cast("string"), lit("."), ext)
    files = named.select(
        (lit(FILE) + col("l_orderkey") * 1000 + col("l_linenumber")).cast("long").alias("id"), (col("l_orderkey") + ORDER).cast("long").alias("parent"), name.alias("name"),
        lit(False).alias("is_dir"), F.round(col("l_extendedprice") * 100).cast("long").alias("size"), epoch("l_shipdate").alias("modified"),
    )
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(orders).unionByName(files)


#: The same as entries(), as the head of a DuckDB statement; adds `folder` (id, path) and `e` (entries with path).
ORACLE = f"""
WITH RECURSIVE item AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1
), entries AS (
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent, '' AS name, true AS is_dir, 0::BIGINT AS size, 0::BIGINT AS modified
  UNION ALL SELECT {REGION} + r_regionkey, 1, r_name, true, 0, 0 FROM region
  UNION ALL SELECT {NATION} + n_nationkey, {REGION} + n_regionkey, n_name, true, 0, 0 FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, {NATION} + c_nationkey, c_name, true, 0, 0 FROM customer
  UNION ALL SELECT {ORDER} + o_orderkey, {CUSTOMER} + o_custkey, 'order-' || o_orderkey, true, 0, epoch_us(o_orderdate) // 1000000 FROM orders
  UNION ALL SELECT {FILE} + l_orderkey * 1000 + l_linenumber, {ORDER} + l_orderkey,
    CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN '.' ELSE '' END || replace(p_name, ' ', [' ', '-', '_'][l_partkey % 3 + 1]) || '-' || l_linenumber || '.' || ['pdf', 'txt', 'PNG', 'zip', 'swift', 'csv', 'Heic', 'mp3'][l_partkey % 8 + 1],
    false, CAST(round(l_extendedprice * 100) AS BIGINT), epoch_us(l_shipdate) // 1000000
  FROM item JOIN part ON l_partkey = p_partkey
), folder AS (
  SELECT id, name AS path, 1 AS depth FROM entries WHERE parent = 0
  UNION ALL SELECT c.id, f.path || '/' || c.name, f.depth + 1 FROM entries c JOIN folder f ON c.parent = f.id WHERE c.is_dir
), ext AS (
  SELECT entries.*, regexp_extract(name, '(?s)^.*[^/]\\.([^./]+)$', 1) AS ext FROM entries
), e AS (
  SELECT x.id, x.parent, x.name, x.is_dir, x.size, x.modified, x.ext,
    CASE WHEN x.parent = 0 THEN CASE WHEN x.name = '' THEN '/' ELSE x.name END ELSE f.path || '/' || x.name END AS path,
    CASE WHEN x.is_dir THEN 'Folder' WHEN x.ext = '' THEN 'File' ELSE upper(x.ext) || ' File' END AS kind
  FROM ext x LEFT JOIN folder f ON x.parent = f.id
)
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, path, flags``: one change event per row of events."""
    ev = read(spark, sf_dir, "events")
    flags = F.create_map(
        F.lit("click"), F.lit(MODIFIED | IS_FILE), F.lit("view"), F.lit(MODIFIED | IS_FILE), F.lit("purchase"), F.lit(CREATED | IS_FILE), F.lit("signup"), F.lit(CREATED | IS_DIR), F.lit("error"), F.lit(MUST_SCAN)
    )
    user = F.concat(F.lit("/user-"), F.col("user_id").cast("string"))
    file = F.concat(user, F.lit("/k-"), F.get_json_object("props", "$.k"), F.lit(".dat"))
    return ev.select(F.col("event_id").cast("long").alias("id"), F.when(F.col("event_type") == "error", user).otherwise(file).alias("path"), F.coalesce(flags[F.col("event_type")], F.lit(0)).cast("long").alias("flags"))


#: The same as feed() in DuckDB.
FEED_ORACLE = f"""
WITH feed AS (
  SELECT event_id AS id, '/user-' || user_id || CASE WHEN event_type = 'error' THEN '' ELSE '/k-' || json_extract_string(props, '$.k') || '.dat' END AS path,
    CASE event_type WHEN 'click' THEN {MODIFIED | IS_FILE} WHEN 'view' THEN {MODIFIED | IS_FILE} WHEN 'purchase' THEN {CREATED | IS_FILE} WHEN 'signup' THEN {CREATED | IS_DIR} WHEN 'error' THEN {MUST_SCAN} ELSE 0 END AS flags
  FROM events
)"""


LISTING = "directory string, name string, is_dir boolean, is_symlink boolean, size long, modified double, failure string"


def _scan(batches):
    """The items of each directory; one that can't be read whole gives none of them, but a row that says why."""
    import os

    import pandas as pd

    for batch in batches:
        for folder in batch["directory"]:
            rows = []
            try:
                with os.scandir(folder) as items:
                    for item in items:
                        st, is_dir = item.stat(follow_symlinks=False), item.is_dir(follow_symlinks=False)
                        rows.append((folder, item.name, is_dir, item.is_symlink(), 0 if is_dir else st.st_size, st.st_mtime, None))
            except OSError as e:
                failure = "missing" if isinstance(e, FileNotFoundError) else "denied" if isinstance(e, PermissionError) else "error"
                rows = [(folder, None, None, None, None, None, failure)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LISTING.split(", ")]).astype({"size": "Int64", "is_dir": "boolean", "is_symlink": "boolean"})


def read_directories(level: DataFrame) -> DataFrame:
    """The directories (column directory) of a tree that all executors can read, as LISTING; one that can't be read whole is a row with its failure."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return level.repartition("directory").mapInPandas(_scan, LISTING)


def listing(spark: SparkSession, root: str, skip: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A directory tree that all executors can read (a shared mount), as LISTING; links are not followed.

    Level by level: the directories of a level are dealt to tasks, which list
    them, and the rows are written, so that neither the driver nor a single
    task ever holds the tree.  Directories that can't be read are rows with a
    failure and no name.  skip(path, name): subtrees that are not walked.
    """
    # functions of this module travel by value: no executor needs the repository on its path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    level, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "directory string"), []
    while True:
        rows = save(level.repartition("directory").mapInPandas(_scan, LISTING), "listing")
        found.append(rows)
        path = F.concat(F.when(F.col("directory") == "/", "").otherwise(F.col("directory")), F.lit("/"), F.col("name"))
        folders = rows.where("failure is null and is_dir and not is_symlink").withColumn("path", path)
        level = (folders.where(~skip(F.col("path"), F.col("name"))) if skip else folders).select(F.col("path").alias("directory"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def from_paths(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Small catalogs for tests: (path[, is_dir[, size[, modified]]]); missing folders are made, folders have size 0, / is the empty name."""
    made: dict[str, int] = {}
    out: dict[int, tuple] = {}

    def put(path: str, is_dir: bool, size: int, modified: int) -> int:
        if path in made:
            ident = made[path]
        else:
            parent = 0
            if path != "/":
                parent = put(path.rsplit("/", 1)[0] or "/", True, 0, 0)
            ident = made[path] = len(made) + 1
            out[ident] = (ident, parent, path.rsplit("/", 1)[1], is_dir, 0 if is_dir else size, modified)
            return ident
        return ident

    for row in rows:
        path, is_dir, size, modified = (*row, *(False, 0, 0)[len(row) - 1 :])
        put(path, is_dir, size, modified)
    from ..schema import ENTRIES

    return spark.createDataFrame(list(out.values()), ENTRIES)
