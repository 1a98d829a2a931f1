"""When a saved cursor may be trusted, and how it moves."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from .. import storage

VERSION, MAX_AGE = 2, 7 * 24 * 3600


@dataclass
class VolumeCursor:
    identity: str
    journal: str
    id: int


@dataclass
class Checkpoint:
    database: str
    config: dict
    saved_at: float
    volumes: list[VolumeCursor] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    version: int = VERSION

    def valid(self, database: str, config: dict, locations: list[str], volumes: list[VolumeCursor], now: float) -> bool:
        """Same catalog, config, locations and volumes; not from the future nor a week old; no journal went backwards."""
        if (self.version, self.database, self.config, sorted(self.locations)) != (VERSION, database, config, sorted(locations)) or not 0 <= now - self.saved_at < MAX_AGE:
            return False
        present = {v.identity: v for v in volumes}
        return set(present) == {v.identity for v in self.volumes} and all(present[v.identity].journal == v.journal and present[v.identity].id >= v.id for v in self.volumes)


def fingerprint(config: dict, identities: list[str], access: bool, topology: list[str] | None = None) -> str:
    """Equal fingerprints: no new full reconcile is due."""
    return json.dumps([config, sorted(identities), access, sorted(topology) if topology is not None else None], sort_keys=True)


class CheckpointFile:
    """JSON beside the catalog, replaced as a whole; a cursor never moves back and an unchanged one is not written.

    With a session, ``path`` is in the shared folder and outlives the driver;
    without one it is a file of this machine.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark
        self.saved: Checkpoint | None = None

    def _read(self) -> str:
        if self.spark:
            return storage.read_text(self.spark, self.path) or ""
        with open(self.path, encoding="utf-8") as f:
            return f.read()

    def _write(self, text: str) -> None:
        if self.spark:
            storage.write_text(self.spark, self.path, text, replace=True)
            return
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{self.path}.new", self.path)

    def follow(self, template: Checkpoint, cursors: dict[str, int], now: float) -> bool:
        """Saves the cursors of a live feed (``on_commit``): the id of each volume of ``template`` up to which all is applied."""
        volumes = [VolumeCursor(v.identity, v.journal, cursors.get(v.identity, v.id)) for v in template.volumes]
        return self.save(replace(template, saved_at=now, volumes=volumes))

    def load(self) -> Checkpoint | None:
        try:
            raw = json.loads(self._read())
            self.saved = Checkpoint(**(raw | {"volumes": [VolumeCursor(**v) for v in raw["volumes"]]}))
        except (OSError, ValueError, TypeError, KeyError):
            self.saved = None
        return self.saved

    def save(self, checkpoint: Checkpoint) -> bool:
        """True if it was written.  A failed write leaves the saved cursor as it was."""
        before = {v.identity: v.id for v in self.saved.volumes} if self.saved else None
        for v in checkpoint.volumes:
            v.id = max(v.id, (before or {}).get(v.identity, 0))
        if before == {v.identity: v.id for v in checkpoint.volumes} and self.saved.config == checkpoint.config:
            return False
        self._write(json.dumps(asdict(checkpoint)))
        self.saved = checkpoint
        return True
