"""A request to one plan: filter, total order, page, paths, and the exact count."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..lang import compile as compiler
from ..lang.filters import Group, analyse
from ..lang.parser import parse
from ..operators import hierarchy
from ..operators.tokens import TokenIndex
from ..sources.scopes import Scope
from ..storage import drop, save, tasks

MAX_LIMIT = 100_000
#: Rows of a page that the driver holds for a moment; larger pages are written.
SMALL_PAGE = 1000


@dataclass(frozen=True)
class Request:
    text: str = ""
    kind: str = "all"  # all, folders or files
    include_hidden: bool = True
    match_path: bool = False
    use_regex: bool = False
    match_case: bool = False
    whole_word: bool = False
    sort: str = "name"  # name, path, size, kind or modified
    ascending: bool = True
    sort_empty: bool = False
    limit: int = 10_000
    offset: int = 0
    scope: Scope | None = None
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    first_weekday: int = 0


def clustered(rows: DataFrame) -> DataFrame:
    """What searches read, in ranges of folder; the rows (entries) are saved ones, since ranges are found by reading them twice."""
    dealt = schema.searchable(rows).repartitionByRange(tasks(rows.sparkSession, rows.count()), "parent", "id")
    return dealt.sortWithinPartitions("parent", "id")


class Catalog:
    """Entries with their folders' paths, which are computed once.

    A catalog is a snapshot: its tables never change, so all pages of it agree.
    """

    def __init__(self, entries: DataFrame, paths: DataFrame | None = None, source: str | None = None):
        self.rows = schema.searchable(entries)
        self.entries = entries
        self.source = source  # where the entries were read, if they were
        self._paths = paths
        self._tokens: TokenIndex | None = None

    @classmethod
    def stored(cls, entries: DataFrame, source: str | None = None) -> Catalog:
        """Written once, clustered by folder, with what searches look at: filters on size, date, kind and extension reach the scan."""
        given = save(entries, "entries")
        rows = save(clustered(given), "catalog")
        drop(given)
        made = cls(rows.select(*schema.COLUMNS), source=source)
        made.rows = rows
        return made

    @property
    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = hierarchy.folder_paths(self.entries)
        return self._paths

    @property
    def tokens(self) -> TokenIndex:
        """The index of the names' words, built and stored when it is first asked for."""
        if self._tokens is None:
            self._tokens = TokenIndex.build(self.entries)
        return self._tokens

    def cache(self) -> Catalog:
        """Memory mode: what searches read and the paths stay in the executors' columnar cache."""
        self.rows.cache()
        self.paths.cache()
        return self

    def release(self) -> None:
        self.rows.unpersist()
        if self._paths is not None:
            self._paths.unpersist()

    def statistics(self) -> DataFrame:
        e = self.entries
        return e.agg(
            F.count("*").alias("n_rows"), F.count_if("is_dir").alias("n_dirs"), F.count_if(~F.col("is_dir")).alias("n_files"),
            F.coalesce(F.sum(schema.name_bytes(F.col("name"))), F.lit(0)).cast("long").alias("name_bytes"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"),
        )


def _blank(request: Request) -> bool:
    return not request.text.strip()


def _keys(request: Request) -> list[tuple]:
    """(key, whether it ascends) of a total order: ties go by name, then id, in ascending order whatever the direction."""
    scoped = request.scope is not None and not request.scope.unrestricted
    name, ident, modified = (F.col("folded"), True), (F.col("id"), True), (F.col("modified"), False)
    if _blank(request) and not request.sort_empty:
        plain = not scoped or request.scope.recent_order
        return [modified, (F.col("id"), False)] if plain else [modified, name, ident]
    if request.sort == "name":
        return [(F.col("folded"), request.ascending), ident]
    if request.sort == "path":
        return [(F.lower("path"), request.ascending), name, ident]
    key = {"size": "size", "modified": "modified", "kind": "is_dir"}[request.sort]
    return [(F.col(key), request.ascending), name, ident]


def order(request: Request) -> list:
    return [key.asc() if ascending else key.desc() for key, ascending in _keys(request)]


def _behind(found: DataFrame, request: Request, last: int) -> DataFrame:
    """The matches that come after the one with the id ``last``: a filter, whatever was on the pages before."""
    keys = _keys(request)
    values = found.where(F.col("id") == last).select(*[key.alias(f"key{n}") for n, (key, _) in enumerate(keys)]).first()
    if values is None:
        raise ValueError(f"row {last} is not among the matches")
    behind = F.lit(False)
    for (key, ascending), value in reversed(list(zip(keys, values, strict=True))):
        value = F.lit(value)
        behind = (key > value if ascending else key < value) | ((key == value) & behind)
    return found.where(behind)


def matches(catalog: Catalog, request: Request) -> DataFrame:
    """All matching rows (with path if the query or the order needs it), not ordered."""
    return _found(catalog, request).drop(*schema.SEARCHED)


def _found(catalog: Catalog, request: Request) -> DataFrame:
    rows = catalog.rows.where("name <> ''")
    if request.kind != "all":
        rows = rows.where(F.col("is_dir") if request.kind == "folders" else ~F.col("is_dir"))
    if not request.include_hidden:
        rows = rows.where(~F.col("name").startswith("."))
    scope = request.scope if request.scope is not None and not request.scope.unrestricted else None
    pattern = None
    if request.use_regex and not _blank(request):
        pattern = request.text
        compiler.check_regex(rows.sparkSession, compiler.regex(pattern, request.match_case))
        groups = [[]]  # in regex mode the typed text is the pattern; only the scope has terms and filters
    else:
        groups = parse(request.text)
    analysed: list[Group] = analyse(groups, request.now, scope, request.first_weekday)
    on_path = compiler.needs_path(analysed, request.match_path) or (pattern is not None and request.match_path)
    if on_path or (request.sort == "path" and not (_blank(request) and not request.sort_empty)):
        required = compiler.required_folders(analysed)
        if required is not None:
            # every match lies below one of these: only their folders' children get paths at all
            rows = _below(rows, catalog, required, request.match_case)
        else:
            rows = hierarchy.with_paths(rows, catalog.paths, "empty" if on_path else "name")
    found = compiler.predicate(analysed, request.match_case, request.whole_word, request.match_path)
    if pattern is not None:
        found = found & compiler.regex_column(pattern, request.match_case, request.match_path)
    return rows.where(found)


def _below(rows: DataFrame, catalog: Catalog, required: list[str], match_case: bool) -> DataFrame:
    path = F.col("path") if match_case else F.lower("path")
    wanted = F.lit(False)
    for folder in required:
        folder = folder if match_case else folder.lower()
        wanted = wanted | schema.contains(F.lit(folder), path)
    roots = rows.where("parent = 0").withColumn("path", hierarchy.full_path(F.lit(None).cast("string"), F.col("name"), F.col("parent")))
    return hierarchy.with_paths(rows, catalog.paths.where("path is not null").where(wanted), how="inner").unionByName(roots)


def _held(page: DataFrame, offset: int) -> DataFrame:
    """A small page in its order as a local table with ranks: no file is left behind."""
    rows = page.toArrow()
    ranks = pa.array(range(offset + 1, offset + 1 + rows.num_rows), pa.int32())
    return page.sparkSession.createDataFrame(rows.add_column(0, "rank", ranks), "rank int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in page.schema))


def search(catalog: Catalog, request: Request, after: tuple[int, int] | None = None) -> DataFrame:
    """The page: ``rank, id, path, name, is_dir, size, modified, kind``; paths are joined to its rows only.

    ``after``: (rank, id) of the row that the page follows, instead of an
    offset.  An offset sends all rows before the page to one task, this only
    the page; it is an error if no match has that id.
    """
    limit = max(1, min(request.limit, MAX_LIMIT))
    keys, found = order(request), _found(catalog, request)
    if after is None:
        before = max(0, request.offset)
        page = found.orderBy(*keys).offset(before).limit(limit)
    else:
        before = after[0]
        page = _behind(found, request, after[1]).orderBy(*keys).limit(limit)
    # at most MAX_LIMIT rows from here on: they go to the folders, which are only read
    if limit <= SMALL_PAGE:
        page = _held(page.select(*schema.COLUMNS), before)
    else:
        page = save(page.withColumn("rank", F.row_number().over(W.orderBy(*keys)) + before).select("rank", *schema.COLUMNS), "page")
    folders = catalog.paths.join(F.broadcast(page.select(F.col("parent").alias("id")).distinct()), "id", "left_semi")
    page = hierarchy.with_paths(page, F.broadcast(folders), few=True)
    return page.select("rank", "id", "path", "name", "is_dir", "size", "modified", schema.kind(F.col("name"), F.col("is_dir")).alias("kind"))


def total(catalog: Catalog, request: Request) -> DataFrame:
    """One row: ``total``, the exact count whatever the page."""
    return matches(catalog, request).agg(F.count("*").alias("total"))


def pages(catalog: Catalog, request: Request, size: int):
    """Pages of one snapshot until one is not full; each is found from the last row of the one before."""
    after, request = None, replace(request, limit=size)
    size = max(1, min(size, MAX_LIMIT))
    while True:
        page = search(catalog, request, after)
        yield page
        last = page.agg(F.count("*").alias("rows"), F.max("rank").alias("rank"), F.max_by("id", "rank").alias("id")).first()
        if last.rows < size:
            return
        after = last.rank, last.id


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """What runs in this block (in this thread) can be ended from another one by ``cancel(spark, tag)``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the jobs of the blocks with this tag; their actions raise."""
    spark.sparkContext.cancelJobsWithTag(tag)


def joined_names(page: DataFrame, column: str = "path") -> DataFrame:
    """Names or paths of a page as one text, a line each, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", column)))
    return page.agg(F.array_join(F.transform(ordered, lambda r: r[column]), "\n").alias("lines"))
