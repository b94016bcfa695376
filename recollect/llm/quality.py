"""Quality scores by a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on labelled documents; every path from
a root is a conjunctive rule. A logistic model with a lasso penalty weighs the rules, most
of them with nothing, and what is left is compiled to one Spark column expression over the
statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm._text import fresh, string_column
from recollect.session import written

#: Labelled documents that the rules are learned from at most; by hash of doc_id, so spread evenly.
#: Up to 10,000 rows the trees look at every value when they choose thresholds.
SAMPLE_ROWS = 10_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.0004, 11
#: Rows whose crc32(doc_id as text) has remainder 0 are held out.
FOLDS = 5
#: Scores from here on are predicted 1.
CUT = 0.3

_UPPER, _LOWER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_SPACE, _STOP, _LOUD, _BAR = b" \t\n\r\x0b\x0c", b".,;:", b"!?", b"|"
_SYMBOL = b"#$%&*+<=>@[\\]^_`{}~/"

STATISTICS = (
    "words",
    "word_length",
    "upper",
    "digits",
    "stops",
    "loud",
    "bars",
    "symbols",
    "space",
    "repeated",
    "distinct",
    "longest_word",
    "repeated_lines",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The STATISTICS of a whole text; shares are of its bytes, letters or words, 0 for an empty text."""
    size = len(text)
    count = lambda chars: size - len(text.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, bytes_, many = len(words), max(size, 1), max(len(words), 1)
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / many,
        upper / max(upper + lower, 1),
        count(_DIGIT) / bytes_,
        count(_STOP) / bytes_,
        count(_LOUD) / bytes_,
        count(_BAR) / bytes_,
        count(_SYMBOL) / bytes_,
        count(_SPACE) / bytes_,
        sum(map(eq, words, islice(words, 1, None))) / many,
        len(set(words)) / many,
        float(min(max(map(len, words), default=0), 100)),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    )


@F.arrow_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in STATISTICS]))
def _statistics(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    rows = np.array([statistics(x.as_buffer().to_pybytes()) for x in string_column(batch, "text")], float)
    columns = rows.reshape(-1, len(STATISTICS)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(STATISTICS))


Condition = tuple[str, bool, float]
"""(statistic, whether at most, threshold)"""


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: the bias and, by weight, conjunctions of conditions."""

    bias: float
    weighted: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self, of) -> Column:
        """The probability of label 1; ``of`` gives the column of a statistic by name."""
        terms = (F.when(_holds(rule, of), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.weighted)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def _holds(rule: tuple[Condition, ...], of) -> Column:
    return reduce(lambda a, b: a & b, ((of(x) <= F.lit(t)) if at_most else (of(x) > F.lit(t)) for x, at_most, t in rule))


def _paths(node, so_far: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    if so_far:
        yield _simplified(so_far)
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), (*so_far, (name, True, at)))
        yield from _paths(node.rightChild(), (*so_far, (name, False, at)))


def _simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest bound of each side of each statistic."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, at_most, t in rule:
        old = bounds.get((name, at_most), t)
        bounds[name, at_most] = min(old, t) if at_most else max(old, t)
    return tuple(sorted((n, m, t) for (n, m), t in bounds.items()))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept from training; null ids, which no label names, are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, statistics): at most ``sample_rows`` labelled documents that are not held out, in a fixed order."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    chosen = (
        labels.select("doc_id", F.col("quality").cast("double").alias("label"))
        .where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(*order)
        .limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows are broadcast
    rows = rows.select("doc_id", "label", _statistics("text").alias("s")).select("doc_id", "label", "s.*").distinct()
    return rows.orderBy(*order, *STATISTICS).limit(sample_rows).select("label", *STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Learn the rules; without both labels, the share of label 1 (a half if there are none) and no rule."""
    rows = written(training_rows(docs, labels, sample_rows).coalesce(1), "quality-sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (ones + 1.0) / (n + 2.0)
    if ones in (0, n):
        return Rules(float(np.log(prior / (1 - prior))), ())
    # read from one small file, so sums are added in the same order each time
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).coalesce(1).cache()
    trees = GBTClassifier(maxDepth=DEPTH, maxIter=TREES, stepSize=0.5, minInstancesPerNode=5, seed=SEED).fit(data).trees
    rules = list(dict.fromkeys(rule for tree in trees for rule in _paths(tree._call_java("rootNode"))))
    data.unpersist()
    if not rules:
        return Rules(float(np.log(prior / (1 - prior))), ())
    held = rows.select("label", *(_holds(rule, F.col).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).coalesce(1).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(held)
    held.unpersist()
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), tuple((float(w), rule) for w, rule in zip(weights, rules, strict=True) if w != 0.0))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents with all columns and ``score``, which replaces a column of that name.

    Null and empty texts have statistics of 0 and are scored by them. Repeated rows, null ids
    and other columns don't matter. No documents: no rows.
    """
    columns = [c for c in docs.columns if c.lower() != "score"]
    (name,) = fresh(docs, "_statistics")
    scored = docs.withColumn(name, _statistics("text"))
    return scored.withColumn("score", rules.score(lambda x: F.col(name)[x])).select(*columns, "score")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The documents whose score is at least ``cut``, columns unchanged."""
    rules = fit(docs, labels, sample_rows)
    (name,) = fresh(docs, "_statistics")
    scored = docs.withColumn(name, _statistics("text"))
    return scored.where(rules.score(lambda x: F.col(name)[x]) >= cut).select(*docs.columns)
