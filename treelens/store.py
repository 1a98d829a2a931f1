"""A stored catalog that changes by transactions: versions over immutable Parquet folders.

A version is a small manifest that names its folders.  A transaction writes new
folders and ends by adding the next manifest, which only one writer can do; a
writer that came too late is refused, and one that fails leaves nothing that a
reader would see.  Entries are a base, clustered by folder, and at most one
layer of changes over it (ids that are void in the base, and new rows), merged
when they are read; other tables of the caller change in the same transaction.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, storage
from .errors import Conflict, StorageFailed
from .operators import hierarchy, mutate
from .operators.tokens import PATCH_LIMIT, TokenIndex
from .plans.search import Catalog, clustered

#: Bytes that must be dead, and their share of all, before ``compact`` rewrites a catalog.
DEAD_BYTES, DEAD_SHARE = 128 << 20, 0.25

_ROWS = "id long, parent long, name string, is_dir boolean, size long, modified long, folded string, ext string"
_TOKENS, _PATHS = "token string, id long, position int", "id long, path string, chain array<long>"


@dataclass
class Version:
    """What a manifest holds; folders are names below the store's own."""

    number: int = 0
    base: str | None = None
    base_rows: int = 0
    base_bytes: int = 0
    tokens: str | None = None
    paths: str | None = None
    void: str | None = None  # ids that do not count in the base
    added: str | None = None  # rows instead of them, and new ones
    added_tokens: str | None = None
    void_rows: int = 0
    data: int = 0  # rises only when rows differ
    tables: dict = field(default_factory=dict)  # name: [folder, schema]

    def folders(self) -> set[str]:
        own = [self.base, self.tokens, self.paths, self.void, self.added, self.added_tokens, *(t[0] for t in self.tables.values())]
        return {f for f in own if f}


class CatalogStore:
    """The catalog below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int | None = None) -> Version:
        """A version, the latest if none is named; number 0 is the empty catalog that every store begins with."""
        number = max(self.numbers(), default=0) if number is None else number
        if number == 0:
            return Version()
        text = storage.read_text(self.spark, self._manifest(number))
        try:
            return Version(**json.loads(text))
        except (TypeError, ValueError) as e:
            raise StorageFailed(f"version {number} of {self.folder} cannot be read") from e

    def read(self, folder: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{folder}")

    def table(self, name: str, number: int | None = None) -> DataFrame | None:
        """One of the caller's own tables."""
        kept = self.version(number).tables.get(name)
        return kept and self.read(*kept)

    def _rows(self, v: Version) -> DataFrame:
        if v.base is None:
            return self.spark.createDataFrame([], _ROWS)
        rows = self.read(v.base, _ROWS)
        if v.void:
            # PATCH_LIMIT bounds what is broadcast
            rows = rows.join(F.broadcast(self.read(v.void, "id long")), "id", "left_anti").select(rows.columns).unionByName(self.read(v.added, _ROWS))
        return rows

    def catalog(self, number: int | None = None) -> Catalog:
        """A snapshot: later commits do not change it (``reading`` keeps its files)."""
        v = self.version(number)
        rows = self._rows(v)
        made = Catalog(rows.select(*schema.COLUMNS), paths=self.read(v.paths, _PATHS) if v.paths else None, source=f"{self.folder}@{v.number}")
        made.rows = rows
        if v.tokens:
            patched = (self.read(v.void, "id long"), self.read(v.added_tokens, _TOKENS)) if v.void else (None, None)
            made._tokens = TokenIndex(self.read(v.tokens, _TOKENS), *patched)
        return made

    @contextmanager
    def reading(self, number: int | None = None):
        """The catalog of a version whose files stay until the block ends, whatever is compacted meanwhile."""
        v = self.version(number)
        pin = f"{self.folder}/pins/{v.number:012d}-{uuid.uuid4().hex}"
        storage.write_text(self.spark, pin, "")
        try:
            yield self.catalog(v.number)
        finally:
            storage.delete(self.spark, pin)

    @contextmanager
    def transaction(self):
        """All changes of the block become one version at its end; an error in it, or another writer's commit, undoes them all."""
        t = Transaction(self)
        try:
            yield t
            t._commit()
        except BaseException:
            t._undo()
            raise

    def dead(self, v: Version | None = None) -> tuple[int, int]:
        """(dead bytes, all bytes) of a version's entries: its share of void rows, and folders that no version needs are dead."""
        v = v or self.version()
        needed = set().union(*(self.version(n).folders() for n in self.numbers())) if self.numbers() else set()
        unused = sum(storage.bytes_below(self.spark, f"{self.folder}/{f}") for f in self._data_folders() if f not in needed or f not in v.folders())
        void = v.base_bytes * min(v.void_rows, v.base_rows) // max(1, v.base_rows)
        return unused + void, unused + sum(storage.bytes_below(self.spark, f"{self.folder}/{f}") for f in v.folders())

    def _data_folders(self) -> list[str]:
        return [n for n in storage.names(self.spark, self.folder) if n.startswith("data-")]

    def compact(self, dead_bytes: int = DEAD_BYTES, dead_share: float = DEAD_SHARE) -> bool:
        """Rewrites the catalog as a base without changes, and frees what nobody reads, once enough is dead."""
        dead, every = self.dead()
        if not self.numbers() or dead < dead_bytes or dead < dead_share * every:
            return False
        with self.transaction() as t:
            if t.start.void:
                t._write_base(self._rows(t.start).select(*schema.COLUMNS))
        self.expire()
        return True

    def expire(self) -> int:
        """Deletes all versions but the latest and those that are being read, and the folders that none of the others has; how many folders.

        Folders of a transaction that has not ended are recognised by its pin.
        """
        latest = max(self.numbers(), default=0)
        pins = storage.names(self.spark, f"{self.folder}/pins")
        pinned = {int(p.split("-")[0]) for p in pins if not p.startswith((".", "writing"))}
        kept = [n for n in self.numbers() if n == latest or n in pinned]
        needed = set().union(*(self.version(n).folders() for n in kept))
        writing = {p.removeprefix("writing-") for p in pins if p.startswith("writing-")}
        for n in self.numbers():
            if n not in kept:
                storage.delete(self.spark, self._manifest(n))
        gone = [f for f in self._data_folders() if f not in needed and f.split("-")[1] not in writing]
        for f in gone:
            storage.delete(self.spark, f"{self.folder}/{f}")
        return len(gone)


class Transaction:
    """Changes on top of the version that was the latest when it began; made by ``CatalogStore.transaction``."""

    def __init__(self, store: CatalogStore):
        self.store, self.spark, self.token = store, store.spark, uuid.uuid4().hex
        storage.write_text(self.spark, f"{store.folder}/pins/writing-{self.token}", "")
        self.start = store.version()
        self.next = Version(**asdict(self.start)) if self.start.number else Version()
        self.written: list[str] = []
        self.buffer: list[DataFrame] = []

    def _write(self, df: DataFrame, name: str, **options) -> str:
        folder = f"data-{self.token}-{name}-{len(self.written)}"
        self.written.append(folder)
        df.write.options(**options).parquet(f"{self.store.folder}/{folder}")
        return folder

    @property
    def entries(self) -> DataFrame:
        """The entries as this transaction has left them so far."""
        return self.store._rows(self.next).select(*schema.COLUMNS)

    def put(self, name: str, df: DataFrame) -> None:
        """Another table, replaced as a whole."""
        self.next.tables = self.next.tables | {name: [self._write(df, name), df._jdf.schema().toDDL()]}

    def append(self, rows: DataFrame) -> None:
        """Bulk load: rows are only gathered here; sorted copies, words and paths are made once, at ``commit``."""
        self.buffer.append(rows.select(*schema.COLUMNS))

    def replace(self, entries: DataFrame) -> None:
        self._write_base(entries.select(*schema.COLUMNS))
        self.next.data += 1

    def _write_base(self, entries: DataFrame) -> None:
        n = self.next
        given = storage.save(entries, "entries")
        n.base = self._write(clustered(given), "rows")
        storage.drop(given)
        rows = self.store.read(n.base, _ROWS)
        n.base_rows, n.base_bytes = rows.count(), storage.bytes_below(self.spark, f"{self.store.folder}/{n.base}")
        index = TokenIndex.build(rows)
        n.tokens = self._write(index.base.sortWithinPartitions("token", "id", "position"), "tokens", **{"parquet.block.size": 4 << 20})
        n.paths = self._write(hierarchy.folder_paths(rows.select(*schema.COLUMNS)), "paths")
        n.void = n.added = n.added_tokens = None
        n.void_rows = 0

    def patch(self, changed: DataFrame, rows: DataFrame) -> bool:
        """Changes by id: ``changed`` (id) of new, changed and deleted rows, ``rows`` the new and changed ones as they are now.

        Writes the changes only.  Past PATCH_LIMIT ids in all since the base was
        written, the base is written again (False).
        """
        n, store = self.next, self.store
        ids = storage.save(changed.select("id").distinct(), "changed")
        rows = storage.save(rows.select(*schema.COLUMNS), "changed-rows")
        void = ids if n.void is None else ids.unionByName(store.read(n.void, "id long")).distinct()
        void = storage.save(void, "void")
        count = void.count()
        if n.base is None or count > PATCH_LIMIT:
            self._write_base(self.entries.join(ids, "id", "left_anti").select(*schema.COLUMNS).unionByName(rows))
            n.data += 1
            return False
        before = store.read(n.added, _ROWS).join(ids, "id", "left_anti").select(schema.searchable(rows).columns) if n.added else None
        folders_change = not self.entries.join(F.broadcast(ids), "id", "left_semi").where("is_dir or parent = 0").isEmpty() or not rows.where("is_dir or parent = 0").isEmpty()
        fresh = schema.searchable(rows)
        n.void, n.void_rows = self._write(void.coalesce(1), "void"), count
        n.added = self._write((fresh if before is None else before.unionByName(fresh)).coalesce(1), "added")
        index = TokenIndex(store.read(n.tokens, _TOKENS)).patch(store.read(n.void, "id long"), store.read(n.added, _ROWS))
        n.added_tokens = self._write(index.added, "words")
        if folders_change:
            n.paths = self._write(hierarchy.folder_paths(self.entries), "paths")
        n.data += 1
        return True

    def evolve(self, after: DataFrame) -> bool:
        """The next entries whole, as ``mutate``'s functions return them: what differs is patched; False, and nothing, if no row does."""
        after = storage.save(after.select(*schema.COLUMNS), "after")
        differs = storage.save(mutate.changes(self.entries, after), "differs")
        if differs.isEmpty():
            return False
        self.patch(differs, after.join(differs.where("change <> 'delete'"), "id", "left_semi").select(*schema.COLUMNS))
        return True

    def _commit(self) -> None:
        if self.buffer:
            rows = self.entries
            for more in self.buffer:
                rows = rows.unionByName(more)
            self._write_base(rows)
            self.next.data += 1
        self.next.number = self.start.number + 1
        if not storage.write_text(self.spark, self.store._manifest(self.next.number), json.dumps(asdict(self.next))):
            raise Conflict(f"version {self.next.number} was committed by another writer")
        storage.delete(self.spark, f"{self.store.folder}/pins/writing-{self.token}")

    def _undo(self) -> None:
        for folder in self.written:
            storage.delete(self.spark, f"{self.store.folder}/{folder}")
        storage.delete(self.spark, f"{self.store.folder}/pins/writing-{self.token}")
