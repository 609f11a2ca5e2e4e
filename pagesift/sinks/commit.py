"""One commit over several outputs: all of a run's files appear, or none.

Outputs are written to a folder beside their place, one after another. If one
fails, the folder goes and nothing has changed. When all are there, a journal is
written that names them, and their partitions are moved into place, each taking
the place of what an earlier try of the run left. A commit that is cut off is
finished from its journal by the next one, or by ``finish_commits``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNALS, STAGED = "_commits", "_staged"


class Commit:
    """Outputs below ``path`` that are partitioned by the columns of ``depth`` levels."""

    def __init__(self, spark: SparkSession, path: str, depth: int) -> None:
        self.spark, self.path, self.depth = spark, path.rstrip("/"), depth
        self.name = uuid.uuid4().hex
        self.staged = f"{self.path}/{STAGED}/{self.name}"

    def write(self, outputs: dict[str, Callable[[str], None]]) -> None:
        """Write each output into the folder it is given, then let all of them appear."""
        finish_commits(self.spark, self.path)
        try:
            for name, write in outputs.items():
                write(f"{self.staged}/{name}")
            journal = self._journal(list(outputs))
        except BaseException:
            _delete(self.spark, self.staged)
            raise
        # From here on the run counts: its journal names all that belongs to it.
        journal.coalesce(1).write.text(f"{self.path}/{JOURNALS}/{self.name}")
        _move(self.spark, self.path, self.name)

    def _journal(self, names: list[str]) -> DataFrame:
        """The outputs, which may be empty, and their partitions, a line each."""
        system, root = _system(self.spark, self.staged)
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.staged}/*" + "/*=*" * self.depth)
        base = system.makeQualified(root).toString()
        found = [s.getPath().toString()[len(base) + 1 :] for s in system.globStatus(pattern) or []]
        return self.spark.createDataFrame([(place,) for place in [*names, *sorted(found)]], "value string")


def _system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def _move(spark: SparkSession, path: str, name: str) -> None:
    """Move what a journal names and is not in place yet; may be repeated."""
    journal = f"{path}/{JOURNALS}/{name}"
    places = [row["value"] for row in spark.read.text(journal).filter(F.length("value") > 0).collect()]
    system, _ = _system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for place in places:
        source, target = hadoop(f"{path}/{STAGED}/{name}/{place}"), hadoop(f"{path}/{place}")
        if "/" not in place:
            system.mkdirs(target)
        elif system.exists(source):
            system.delete(target, True)
            system.mkdirs(target.getParent())
            if not system.rename(source, target):
                raise OSError(f"could not move {source} to {target}")
    _delete(spark, f"{path}/{STAGED}/{name}")
    _delete(spark, journal)


def finish_commits(spark: SparkSession, path: str) -> None:
    """Finish commits that were cut off while they moved their files.

    A journal counts once it is whole; what was staged without one never happened
    and stays out of sight.
    """
    system, root = _system(spark, f"{path.rstrip('/')}/{JOURNALS}")
    for found in (system.listStatus(root) if system.exists(root) else []):
        name = found.getPath().getName()
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")):
            _move(spark, path.rstrip("/"), name)
