"""Maintenance of what has changed: the findings of a full run, from the ones before and the rows that are new."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.maintenance import DUPLICATE, contradictions
from recollect.operators.retrieval import similarities


def duplicates_after(known: DataFrame, old: DataFrame, new: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(id, superseded_by), as ``maintenance.duplicates`` finds over old and new vectors (id, v) together.

    known are the findings over the old ones. Only pairs with a new vector are compared: new x all, not all x all.
    """
    pairs = similarities(new, old.unionByName(new), threshold)
    found = pairs.select(F.least("i", "j").alias("id"), F.greatest("i", "j").alias("superseded_by"))
    return known.select("id", "superseded_by").unionByName(found).groupBy("id").agg(F.min("superseded_by").alias("superseded_by"))


def contradictions_after(known: DataFrame, rows: DataFrame, changed: DataFrame, by: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """(id, superseded_by, reason, *by), as ``maintenance.contradictions`` finds over the rows, by the keys that changed (*by) has rows of.

    known are the findings before, with their keys. A row's neighbours are in its own key, so findings
    of other keys stay as they are.
    """
    keys = changed.select(*by).distinct()
    again = contradictions(rows.join(keys, list(by), "left_semi"), by).join(rows.select("id", *by), "id")
    return known.join(keys, list(by), "left_anti").select("id", "superseded_by", "reason", *by).unionByName(again.select("id", "superseded_by", "reason", *by))


@dataclass
class Lease:
    """Leave for one run at a time: a file in the shared folder that only one process can make.

    A lease that is older than ``seconds`` belongs to a process that died, and is taken over.
    """

    spark: SparkSession
    path: str
    seconds: float = 3600.0

    def _file(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def take(self) -> bool:
        files, path = self._file()
        if files.exists(path) and time.time() - files.getFileStatus(path).getModificationTime() / 1000 > self.seconds:
            files.delete(path, False)
        return files.createNewFile(path)

    def give(self) -> None:
        files, path = self._file()
        files.delete(path, False)
