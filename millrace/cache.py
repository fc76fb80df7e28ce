"""A catalog of materialised tables that are made anew when what they depend on is newer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Maker = Callable[[SparkSession, "Catalog"], DataFrame]


@dataclass
class Catalog:
    """Named tables below a folder; a manifest holds when each was made and from which others."""

    spark: SparkSession
    folder: str
    makers: dict[str, Maker] = field(default_factory=dict)
    log: list[tuple[float, str, str]] = field(default_factory=list)
    _open: list[str] = field(default_factory=list)

    def add(self, name: str, make: Maker) -> None:
        """How to make a table; other tables it asks for become its dependencies."""
        self.makers[name] = make

    def _manifest(self) -> dict:
        try:
            rows = self.spark.read.text(f"{self.folder}/_manifest").collect()  # one line
            return json.loads(rows[0].value) if rows else {}
        except Exception as e:  # the first use of a folder
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def _save(self, manifest: dict) -> None:
        line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.folder}/_manifest")

    def stale(self, name: str, manifest: dict | None = None) -> bool:
        """Whether a table is missing, or one that it depends on is stale or newer."""
        manifest = self._manifest() if manifest is None else manifest
        mine = manifest.get(name)
        if mine is None:
            return True
        return any(self.stale(d, manifest) or manifest[d]["made"] > mine["made"] for d in mine["needs"])

    def get(self, name: str) -> DataFrame:
        """The table, made first if it is stale."""
        if name in self._open:
            raise ValueError(f"{name} depends on itself: {' > '.join(self._open)}")
        if self._open:
            self._needs[-1].add(name)
        if self.stale(name):
            self._open.append(name)
            self._needs.append(set())
            try:
                # a folder a making: readers of the last one aren't disturbed
                path = f"{self.folder}/{name}/{time.time_ns()}"
                self.makers[name](self.spark, self).write.parquet(path)
                manifest = self._manifest()
                manifest[name] = {"made": time.time(), "needs": sorted(self._needs[-1]), "path": path}
                self._save(manifest)
                self.log.append((time.time(), name, "made"))
            finally:
                self._open.pop()
                self._needs.pop()
        return self.spark.read.parquet(self._manifest()[name]["path"])

    def __post_init__(self):
        self._needs: list[set[str]] = []

    def touch(self, name: str) -> None:
        """Marks a table as changed just now."""
        manifest = self._manifest()
        manifest[name]["made"] = time.time()
        self._save(manifest)
