"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target /
source size. The whole part is taken as is; the fractional parts are rounded
together: a document and the pool of shorter ones, or another document, exchange word
mass (size times probability) at random, without bias, until one side is integral, so
the source's total never moves. Groups of bounded size do this side by side; the single
undecided document that each group leaves goes up a reduction tree until one
document per source is left, which alone is rounded to the nearer side.

Groups are formed by hash and worked through by falling size, so neither
partitioning nor retries change the outcome, a source with a third of all rows
is only more groups, and the document left at the end tends to be a short one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm._text import fresh, string_column, word_counts
from recollect.session import written

WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words to take, most copies of a document.
BUDGET, MOST_COPIES = 1.5, 2.0
#: Documents of a leaf group; residuals that meet in a node of the tree.
GROUP_ROWS, FAN_IN = 4096, 64
#: Most sources whose targets are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = word_counts(string_column(batch, "text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"]
        )


@F.arrow_udf(T.LongType())
def _size(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(string_column(pa.RecordBatch.from_arrays([texts], ["text"]), "text")))


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each text; a null text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_sizes, "doc_id long, source string, size long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES
) -> DataFrame:
    """(source, n_docs, source_size, target): words to take of each source.

    Sources in code-point order, null last, have the ``weights`` in turn and share
    ``budget`` times all words by weight; a target stops at ``most`` times its source
    and the excess goes to the others by weight. Sorted by size over weight the stopped
    sources come first, so one pass of running sums finds the common rate of the rest, the largest one seen.
    The window runs over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
    )
    per = per.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rate = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum(
        "w"
    ).over(after)
    per = per.withColumn("rate", rate)
    # the rate rises while stopped sources drop out and falls afterwards
    target = F.least("top", F.max("rate").over(everything) * F.col("w"))
    return per.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def _uniform(doc_id: object, size: int, nth: int, salt: int) -> float:
    return xxhash.xxh64_intdigest(f"{doc_id}|{size}|{nth}|{salt}") / 2.0**64


def pivot_pool(sizes: np.ndarray, p: float, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities that are all ``p``; the sum of sizes * p and every expectation stay, but for float error.

    In the order given (by falling size, so that short documents are left to balance long
    ones) each document is paired with the pool of all after it. Mass goes from the one to
    the other until the document or the whole pool is integral; the pool gives or takes
    evenly, so its members stay equal. Sizes are positive. Returns the new probabilities, 0
    or 1 but for one at most, and the index of that one or -1.
    """
    out, pool, y = np.zeros(len(sizes)), float(sizes.sum()), float(p)
    for i, a in enumerate(sizes):
        pool -= a
        up, down = min(a * (1 - y), pool * y), min(a * y, pool * (1 - y))
        if y in (0.0, 1.0) or i == len(sizes) - 1:
            out[i:] = y
            return out, i if 0.0 < y < 1.0 else -1
        if draws[i] * (up + down) < down:  # the document gains, with the chance that keeps expectations
            out[i] = 1.0 if up == a * (1 - y) else y + up / a
            y = 0.0 if up == pool * y else y - up / pool
        else:
            out[i] = 0.0 if down == a * y else y - down / a
            y = 1.0 if down == pool * (1 - y) else y + down / pool
        if 0.0 < out[i] < 1.0:
            out[i + 1 :] = y
            return out, i
    return out, -1


def pivot_pairs(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """The same for any probabilities: the undecided document is paired with the next one, again and again."""
    out, carry = p.astype(float), -1
    for i, y in enumerate(out):
        if not 0.0 < y < 1.0:
            continue
        if carry < 0:
            carry = i
            continue
        a, b, x = sizes[carry], sizes[i], out[carry]
        up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
        if draws[i] * (up + down) < down:
            out[carry] = 1.0 if up == a * (1 - x) else x + up / a
            out[i] = 0.0 if up == b * y else y - up / b
        else:
            out[carry] = 0.0 if down == a * x else x - down / a
            out[i] = 1.0 if down == b * (1 - y) else y + down / b
        left = [k for k in (carry, i) if 0.0 < out[k] < 1.0]
        carry = left[0] if left else -1
    return out, carry


def _round_group(salt: int, leaf: bool, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable", ignore_index=True)
        nth = rows.groupby(["doc_id", "size"], dropna=False).cumcount()  # tells repeated rows apart
        draws = np.array([_uniform(d, s, n, salt) for d, s, n in zip(rows["doc_id"], rows["size"], nth, strict=True)])
        sizes, p = rows["size"].to_numpy(float), rows["p"].to_numpy(float)
        # in a leaf all are of one source, so all have its probability
        p, rest = pivot_pool(sizes, p[0], draws) if leaf else pivot_pairs(sizes, p, draws)
        if last and rest >= 0:
            p[rest] = float(p[rest] >= 0.5)  # one document of a source is as near as can be, not random
            rest = -1
        rows["p"] = p
        rows["done"] = np.arange(len(rows)) != rest
        return rows

    return run


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST_COPIES,
    seed: int = 7,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    copies is a whole number up to ``most`` rounded up; taken is copies * size. Null or
    empty texts have size 0 and take nothing; a null source is a source; repeated rows
    and null doc_ids are documents of their own; extra columns are not read. The sum of
    taken in a source is off its target by less than one document. No documents: no rows.
    """
    sizes = written(document_sizes(docs), "mix-sizes")
    targets = source_targets(sizes, weights, budget, most)
    targets = written(targets, "mix-targets")
    n_sources, largest = targets.agg(F.count("*"), F.max("n_docs")).first()
    targets = targets.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("base", F.floor(rate).cast("long"))
        .withColumn("p", rate - F.col("base"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.ceil(F.col("n_docs") / group_rows)))
        .select("doc_id", "source", "size", "source_size", "target", "base", "p", "cell")
    )
    fields = "doc_id long, source string, size long, source_size long, target double, base long, p double, cell long"
    open_: Column = (F.col("size") > 0) & (F.col("p") > 0)
    settled = rows.where(~open_).withColumn("p", F.lit(0.0)).withColumn("done", F.lit(True))
    cells, level, rows = math.ceil((largest or 0) / group_rows), 0, rows.where(open_)
    while True:
        last = cells <= 1
        step = rows.groupBy("source", "cell").applyInPandas(_round_group(seed + 2 * level, level == 0, last), f"{fields}, done boolean")
        step = written(step, f"mix-level{level}")
        settled = settled.unionByName(step.where("done"))
        if last:
            break
        rows = step.where("NOT done").drop("done").withColumn("cell", F.floor(F.col("cell") / fan_in))
        cells, level = math.ceil(cells / fan_in), level + 1
    copies = F.col("base") + F.col("p").cast("long")
    return settled.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The documents as often as ``mix(docs, **how)`` takes them, with ``copy`` counting from 1.

    Documents that the mix leaves out are gone. Rows of a null or repeated doc_id are told
    apart by source and size; equal ones share out the copies of all of them in any order.
    A column ``copy`` of the documents is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != "copy"]
    row, size, each, nth, copies = fresh(docs, "_key", "_size", "_each", "_nth", "_copies")
    key = lambda x: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), x, "source").alias(row)
    taken = mix(docs, **how).where("copies > 0").groupBy(key("size")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(each))
    # one shuffle of the texts, by the key of both the join and the window
    joined = docs.withColumn(size, _size("text")).select("*", key(size)).repartition(row).join(taken, row)
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(size)) - 1)
    joined = joined.withColumn(copies, F.get(each, nth).cast("int")).where(F.col(copies) > 0)
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy"))
