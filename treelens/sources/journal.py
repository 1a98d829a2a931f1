"""Change journals of volumes, and a streaming source that replays them.

A journal is a folder with one folder for each volume; events come in segments,
Parquet files named by their first and last id.  The source's offset is the last
id of every volume, so a stream can start anywhere (option ``since``), and what
lies between two offsets is read on the executors, a segment in a task.
"""

from __future__ import annotations

import json
import re
import sys
import time
import urllib.parse

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# the source travels by value: no worker needs this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "change_journal"
SCHEMA = "volume string, id long, path string, flags long"
_SEGMENT = re.compile(r"(\d{20})-(\d{20})\.parquet")


def _file_system(folder: str):
    """(file system, path) of a folder given as a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)


def _names(folder: str) -> list[str]:
    from pyarrow import fs

    system, path = _file_system(folder)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def write_events(events: DataFrame, folder: str, segment_events: int = 100_000) -> int:
    """Appends ``volume, id, path, flags`` to a journal; the number of segments.

    Ids rise within a volume and lie above what its journal holds.  Ranges of
    (volume, id) are written by the tasks that hold them, each segment under a
    name that a repeated task writes again.
    """

    def run(batches):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq

        held: dict[str, list] = {}

        def put(volume: str, rows: list) -> str:
            name = f"{rows[0][0]:020d}-{rows[-1][0]:020d}.parquet"
            place = f"{folder}/{urllib.parse.quote(volume, safe='')}"
            system, path = _file_system(place)
            system.create_dir(path, recursive=True)
            ids, paths, flags = zip(*rows)
            table = pa.table({"id": pa.array(ids, pa.int64()), "path": pa.array(paths, pa.string()), "flags": pa.array(flags, pa.int64())})
            # a reader sees a segment whole or not at all
            pq.write_table(table, f"{path}/.{name}", filesystem=system)
            system.move(f"{path}/.{name}", f"{path}/{name}")
            return name

        for batch in batches:
            written = []
            for row in zip(batch["volume"], batch["id"], batch["path"], batch["flags"]):
                rows = held.setdefault(row[0], [])
                rows.append((int(row[1]), row[2], int(row[3])))
                if len(rows) >= segment_events:
                    written.append(put(row[0], held.pop(row[0])))
            yield pd.DataFrame({"segment": pd.Series(written, dtype=object)})
        yield pd.DataFrame({"segment": pd.Series([put(v, rows) for v, rows in held.items()], dtype=object)})

    rows = events.select("volume", F.col("id").cast("long").alias("id"), "path", F.col("flags").cast("long").alias("flags"))
    return rows.repartitionByRange("volume", "id").sortWithinPartitions("volume", "id").mapInPandas(run, "segment string").count()


class _Segment(InputPartition):
    """A segment's events with ids above ``low`` and up to ``high``."""

    def __init__(self, volume: str, path: str, low: int, high: int):
        self.volume, self.path, self.low, self.high = volume, path, low, high


class JournalSource(DataSource):
    """Options: ``path``, the journal's folder; ``since``, a JSON object of the last id that was seen of each volume (others: from the start)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802
        return JournalReader(self.options["path"].rstrip("/"), json.loads(self.options.get("since", "{}")))


class JournalReader(DataSourceStreamReader):
    def __init__(self, folder: str, since: dict[str, int]):
        self.folder, self.since = folder, since
        # part of the offset: a query that starts again runs a batch at once, so that timers and retries of the last one go on without an event
        self.started = time.time_ns()

    def segments(self) -> dict[str, list[tuple[int, int, str]]]:
        """(first id, last id, path) of each segment by volume, in order."""
        found = {}
        for name in _names(self.folder):
            inside = [(m, f"{self.folder}/{name}/{m[0]}") for m in map(_SEGMENT.fullmatch, _names(f"{self.folder}/{name}")) if m]
            found[urllib.parse.unquote(name)] = sorted((int(m[1]), int(m[2]), path) for m, path in inside)
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        return {"volumes": dict(self.since), "started": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = {v: max([self.since.get(v, 0), *(high for _, high, _ in segments)]) for v, segments in self.segments().items()}
        return {"volumes": self.since | last, "started": self.started}

    def partitions(self, start: dict, end: dict) -> list[_Segment]:
        start, end = start["volumes"], end["volumes"]
        return [
            _Segment(volume, path, start.get(volume, self.since.get(volume, 0)), end[volume])
            for volume, segments in self.segments().items()
            for first, last, path in segments
            if volume in end and last > start.get(volume, self.since.get(volume, 0)) and first <= end[volume]
        ]

    def read(self, part: _Segment):
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, path = _file_system(part.path)
        with pq.ParquetFile(path, filesystem=system) as f:
            for batch in f.iter_batches(columns=["id", "path", "flags"]):
                ids = batch.column("id").to_numpy()
                batch = batch.filter(pa.array((ids > part.low) & (ids <= part.high)))
                volume = pa.array([part.volume] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([volume, *batch.columns], names=["volume", "id", "path", "flags"])

    def commit(self, end: dict) -> None:
        """Journals are kept: a cursor that was saved elsewhere may be older."""


def stream(spark: SparkSession, folder: str, since: dict[str, int] | None = None) -> DataFrame:
    """A stream of ``volume, id, path, flags``: what stands behind ``since``, then what comes."""
    spark.dataSource.register(JournalSource)
    return spark.readStream.format(FORMAT).option("path", folder).option("since", json.dumps(since or {})).load()
