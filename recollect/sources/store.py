"""A stored table of memories that changes in place, part by part, and by whole commits.

Rows are in parts of consecutive ids. A change writes a new version of the parts that it touches
and of no others, all into one folder, there by status, then by part and id: files are as many as
tasks and statuses, however many parts there are. One small file in ``commits`` makes all of them
valid at once. Readers take the last committed version of each part, so a writer that dies
leaves nothing but files that nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of a part; ids (8 bytes each) that may be sent to every task.
PART_IDS, FEW_IDS = 100_000, 1_000_000
COMMITS = "version long, part long, n long"


@dataclass
class Store:
    """``read``, ``lookup``, ``append`` and ``change`` of a table (id long, status string, ..); one writer at a time."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ids: int = PART_IDS

    @classmethod
    def create(cls, rows: DataFrame, path: str, ids: int = PART_IDS) -> Store:
        store = cls(rows.sparkSession, path, rows.schema, ids)
        store._commit(rows, 0, [])
        return store

    def _part(self, of: Column) -> Column:
        return F.floor(of / self.ids).cast("long")

    def _commits(self) -> dict[int, dict[int, int]]:
        """By version, the rows of each part that it wrote; as many as parts."""
        made: dict[int, dict[int, int]] = {}
        for r in self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect():
            made.setdefault(r["version"], {})[r["part"]] = r["n"]
        return made

    def live(self) -> dict[int, int]:
        """The committed version of each part that has rows; as many as parts."""
        return self._live(self._commits())

    @staticmethod
    def _live(made: dict[int, dict[int, int]]) -> dict[int, int]:
        last = {p: (v, n) for v, parts in sorted(made.items()) for p, n in parts.items()}
        return {p: v for p, (v, n) in last.items() if n > 0}

    def _commit(self, rows: DataFrame, version: int, touched: list[int]) -> dict[int, int]:
        path = f"{self.path}/data/version={version}"
        dealt = rows.withColumn("part", self._part(F.col("id"))).withColumn("_status", F.col("status"))
        dealt = dealt.repartitionByRange("_status", "part", "id").sortWithinPartitions("_status", "part", "id")
        # an attempt that died may have left files of this version
        dealt.write.mode("overwrite").partitionBy("_status").parquet(path)
        made = {r["part"]: r["n"] for r in self._files(path).groupBy("part").agg(F.count("*").alias("n")).collect()}
        made = {p: made.get(p, 0) for p in {*touched, *made} if not touched or p in touched}
        self.spark.createDataFrame([(version, p, n) for p, n in made.items()], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return made

    def _files(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/data").parquet(*paths)

    def _rows(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of ``parts``, or all: of each version that has some, the parts that no later one wrote."""
        made, of = self._commits(), {}
        for part, version in self._live(made).items():
            of.setdefault(version, []).append(part)
        wanted = of if parts is None else {v: w for v, live in of.items() if (w := sorted({*parts} & {*live}))}
        if not wanted:
            return self.spark.createDataFrame([], self._stored())
        rows = self._files(*(f"{self.path}/data/version={v}" for v in sorted(wanted)))
        some, whole = [], True
        for version, own in sorted(wanted.items()):
            others = {p for p, n in made[version].items() if n > 0} - {*own}
            few = others if len(others) < len(own) else own
            which = f" AND part {'NOT ' * (few is others)}IN ({', '.join(f'{p}L' for p in sorted(few))})" if others else ""
            some.append(f"(version = {version}L{which})")
            whole = whole and not others
        return rows if whole else rows.where(" OR ".join(some))

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("part", T.LongType()), T.StructField("version", T.LongType()), T.StructField("_status", T.StringType())])

    def read(self, *status: str) -> DataFrame:
        """All rows, or those of some status: files of others are not opened."""
        rows = self._rows()
        return (rows.where(F.col("_status").isin(*status)) if status else rows).select(*self.schema.names)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (id): only parts that have one of them are opened, and the table isn't shuffled if the ids are few."""
        wanted = ids.select("id").where("id IS NOT NULL").distinct()
        parts = [r[0] for r in wanted.select(self._part(F.col("id"))).distinct().collect()]  # as many as parts
        few = wanted.limit(FEW_IDS + 1).count() <= FEW_IDS
        return self._rows(parts).join(F.broadcast(wanted) if few else wanted, "id", "left_semi").select(*self.schema.names)

    def append(self, rows: DataFrame) -> dict[int, int]:
        """Add rows with new ids: parts that get some are written anew."""
        return self.change(rows, lambda old, new: old.unionByName(new.select(*self.schema.names)))

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[int, int]:
        """Commit ``apply(rows, changes)`` for the parts that changes (id, ..) touch; gives the rows of each part written.

        ``apply`` sees the rows of those parts only; ids neither move nor appear in others.
        """
        parts = [r[0] for r in changes.select(self._part(F.col("id"))).where("id IS NOT NULL").distinct().collect()]
        if not parts:
            return {}
        after = apply(self._rows(parts).select(*self.schema.names), changes).select(*self.schema.names)
        last = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").agg(F.max("version")).first()[0]
        return self._commit(after, last + 1, parts)
