"""Restore points of files: backups before a change, and their manifest."""

from __future__ import annotations

import datetime
import fcntl
import json
import os
import secrets
import shutil
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "id string, ts timestamp, files array<string>, message string"


@dataclass
class RestorePoints:
    """Kept in a folder of a tree; the manifest is JSON lines, the last 100 of which stay."""

    spark: SparkSession
    root: str
    folder: str = ".codeloom-history"
    most: int = 100

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, self.folder, *parts)

    def points(self) -> DataFrame:
        """In order of time; none if there is no manifest or it can't be read."""
        if not os.path.exists(self._path("manifest.json")):
            return self.spark.createDataFrame([], POINTS)
        return self.spark.read.schema(POINTS).json(self._path("manifest.json")).filter("id is not null").orderBy("ts", "id")

    def create(self, files: list[str], message: str) -> str:
        """Backs up the files that there are, each under its own path, and adds a point.

        The manifest is changed under a lock and replaced in one step, so two writers keep each other's
        points and a reader never sees half of it; lines that can't be read go.
        """
        stamp = time.time()
        point = f"rp-{int(stamp * 1000)}-{secrets.token_hex(3)}"
        there = [f for f in files if os.path.isfile(os.path.join(self.root, f))]
        for f in there:
            os.makedirs(os.path.dirname(self._path("backups", point, f)), exist_ok=True)
            shutil.copyfile(os.path.join(self.root, f), self._path("backups", point, f))
        os.makedirs(self._path(), exist_ok=True)
        at = datetime.datetime.fromtimestamp(int(stamp * 1000) / 1000, datetime.UTC)
        row = {"id": point, "ts": at.isoformat(timespec="milliseconds").replace("+00:00", "Z"), "files": there, "message": message}
        with open(self._path("manifest.lock"), "w", encoding="utf-8") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            kept = self._lines()[-(self.most - 1) :] if self.most > 1 else []
            aside = self._path(f"manifest.{point}")
            with open(aside, "w", encoding="utf-8") as f:
                f.write("\n".join([*kept, json.dumps(row)]) + "\n")
            os.replace(aside, self._path("manifest.json"))
        return point

    def _lines(self) -> list[str]:
        """The manifest's lines that are points, in order of time."""
        if not os.path.exists(self._path("manifest.json")):
            return []
        found = []
        with open(self._path("manifest.json"), encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    point = json.loads(line)
                    found.append((str(point["ts"]), str(point["id"]), line.strip()))
                except (ValueError, KeyError, TypeError):
                    continue
        return [line for *_, line in sorted(found)]

    def restore(self, point: str) -> list[str]:
        """Puts a point's files back, and tells which; an unknown id raises."""
        found = self.points().filter(F.col("id") == point).first()
        if found is None:
            raise KeyError(f"Restore point {point} not found")
        done = []
        for f in found.files:
            if os.path.isfile(self._path("backups", point, f)):
                os.makedirs(os.path.dirname(os.path.join(self.root, f)) or ".", exist_ok=True)
                shutil.copyfile(self._path("backups", point, f), os.path.join(self.root, f))
                done.append(f)
        return done
