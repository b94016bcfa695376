"""A stored vector index that gives exact answers: cells around pivots, skipped by bounds on angles.

Each vector is in the cell of its nearest pivot; a cell knows between which angles to the pivot
its vectors are. By the triangle inequality of angles a vector of a cell is at least
max(0, a - high, low - a) away from a query at angle a to the pivot, so a cell's best possible
similarity is known before it is opened. A query opens the cells that promise most until it has
k rows, and then only those that promise more than the k-th of these.

Near vectors prune well where there are clusters. Where vectors are at random in many
dimensions all bounds are near 1 and every cell is opened; answers are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.session import written

#: Pivots go to every task: 1,024 at most. Vectors of a block.
MOST_PIVOTS, BLOCK = 1_024, 512
#: Bounds are widened by this, so that rounding never skips a cell.
SLACK = 1e-7

BLOCKS = "cell int, chunk long, n long, ids array<long>, data binary"
CELLS = "cell int, n long, low double, high double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether a vector has a direction at all)."""
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size < 1e-10, 1.0, size)[:, None], size >= 1e-10


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_directions(x)[0] @ pivots.T, -1.0, 1.0))


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """(key, chunk, n, ids, data) of rows (id, key, v): blocks of about ``block`` vectors, however many a key has."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("long").alias("chunks"))
    dealt = rows.join(F.broadcast(sizes), key).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))  # a row for each cell

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        made = {key: [group[key].iloc[0]], "chunk": [group["chunk"].iloc[0]], "n": [len(group)], "ids": [group["id"].tolist()], "data": [_matrix(group["v"]).tobytes()]}
        return pd.DataFrame(made)

    return dealt.groupBy(key, "chunk").applyInPandas(pack, BLOCKS)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, vectors: DataFrame, path: str, block: int = BLOCK) -> VectorIndex:
        """Store vectors (id, v), all of one length; about as many pivots as the square root of their number."""
        spark = vectors.sparkSession
        vectors = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
        most = min(MOST_PIVOTS, math.isqrt(vectors.count()) + 1)
        chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(most)
        chosen.select("v").write.parquet(f"{path}/pivots")
        index = cls(spark, path)
        pivots = index._pivots()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["v"])
                angle = _angles(x, pivots)
                nearest = angle.argmin(axis=1)
                # a vector without a direction is as far from everything
                some = _directions(x)[1]
                yield batch.assign(cell=np.where(some, nearest, -1).astype("int32"), angle=np.where(some, angle[np.arange(len(x)), nearest], math.pi / 2))

        placed = written(vectors.mapInPandas(place, "id long, v array<double>, cell int, angle double"), "placed-vectors")
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).write.parquet(f"{path}/cells")
        _dealt(placed, "cell", block).write.parquet(f"{path}/blocks")
        return index

    def _pivots(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/pivots").collect()  # MOST_PIVOTS at most
        return _directions(np.array([r["v"] for r in rows], float).reshape(len(rows), -1))[0] if rows else np.zeros((0, 1))

    def _cells(self) -> pd.DataFrame:
        rows = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").collect()  # as many as pivots, and one
        return pd.DataFrame([r.asDict() for r in rows], columns=["cell", "n", "low", "high"]).sort_values("cell", ignore_index=True)

    def _opened(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """(id, v, cells array<struct<cell, bound>>, first): the cells that a query may open, best bound first; ``first`` of them hold k others."""
        pivots, cells = self._pivots(), self._cells()
        if not len(cells):
            return queries.select("id", "v", F.expr("array()").cast("array<struct<cell: int, bound: double>>").alias("cells"), F.lit(0).alias("first"))
        number, low, high, n = (cells[c].to_numpy() for c in ("cell", "low", "high", "n"))
        none = number < 0

        def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["v"])
                some = _directions(x)[1]
                angle = _angles(x, pivots)[:, np.where(none, 0, number)]
                bound = np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle))) + SLACK
                bound[:, none], bound[~some, :] = SLACK, SLACK  # their similarity is 0
                by = np.argsort(-bound, axis=1, kind="stable")
                reach = np.cumsum(n[by], axis=1)
                first = (reach < k + 1).sum(axis=1) + 1
                rows = []
                for i in range(len(x)):
                    rows.append([{"cell": int(number[c]), "bound": float(bound[i, c])} for c in by[i] if bound[i, c] > floor])
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "cells": rows, "first": first})

        return queries.select("id", "v").mapInPandas(order, "id long, v array<double>, cells array<struct<cell: int, bound: double>>, first int")

    def _hits(self, asked: DataFrame, k: int, floor: float) -> DataFrame:
        """(query_id, id, cosine) of asked (id, v, cell): a query's k best of each block, and those equal to the last."""
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks").select("cell", "ids", "data")
        asks = _dealt(asked, "cell", BLOCK).select("cell", F.col("ids").alias("a_ids"), F.col("data").alias("a_data"))

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i, x, j, y in zip(*(batch[c] for c in ("a_ids", "a_data", "ids", "data")), strict=True):
                    i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
                    x, y = np.frombuffer(x).reshape(len(i), -1), np.frombuffer(y).reshape(len(j), -1)
                    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                    cosine = np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size >= 1e-10)
                    ok = (cosine > floor) & (i[:, None] != j[None, :])
                    if len(j) > k:
                        ok &= cosine >= np.partition(np.where(ok, cosine, -np.inf), -k, axis=1)[:, -k][:, None]
                    p, q = np.nonzero(ok)
                    yield pd.DataFrame({"query_id": i[p], "id": j[q], "cosine": cosine[p, q]})

        return asks.join(blocks, "cell").mapInPandas(products, "query_id long, id long, cosine double")

    def _visits(self, queries: DataFrame, k: int, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits of the first visits, second visits (id, v, cell), number of cells opened)."""
        asked = written(self._opened(queries, k, floor), "asked-vectors")
        first = asked.select("id", "v", F.explode(F.slice("cells", F.lit(1), F.col("first"))).alias("c")).select("id", "v", "c.cell")
        hits = written(self._hits(first, k, floor), "near-vectors")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc()))
        least = hits.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("cosine").alias("least"))
        more = asked.join(least, "id", "left").select("id", "v", F.explode(F.filter(F.slice("cells", F.col("first") + 1, F.greatest(F.lit(0), F.size("cells"))), lambda c: F.coalesce(c["bound"] >= F.col("least"), F.lit(True)))).alias("c"))
        return hits, more.select("id", "v", "c.cell"), first.select("id", "cell").unionByName(more.select("id", "c.cell"))

    def search(self, queries: DataFrame, k: int = 10, floor: float = -1.0) -> DataFrame:
        """(query_id, id, cosine, rank): the k most similar of all vectors to each of queries (id, v), itself left out, above ``floor``; ties by id."""
        hits, more, _ = self._visits(queries, k, floor)
        both = hits.unionByName(self._hits(more, k, floor))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("id")))
        return both.withColumn("rank", rank).where(F.col("rank") <= k)

    def compared(self, queries: DataFrame, k: int = 10, floor: float = -1.0) -> int:
        """Pairs of a query and a vector that ``search`` compares."""
        _, _, opened = self._visits(queries, k, floor)
        sizes = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").select("cell", "n")
        return opened.join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
