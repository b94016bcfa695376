"""Ranked lexical search: an index of dual-sorted wavelet trees, exact top k by best-first search.

Documents are packed to shards. The postings of a shard are one sequence of documents,
term after term, those of a term by falling impact; a wavelet matrix holds the sequence. A
node of it is a range of documents by doc_id, and each term has a range of places at each
node, still by impact, so that

* the first place of a term at a node bounds what the term adds to any document below it,
  and the sum over a query's terms bounds the scores of the subtree;
* at a leaf, a single document, the bound is its score.

A search expands nodes best bound first, ``BEAM`` at a time, both halves of each at once for
all terms, and stops when no bound is left that could enter the k best. Bounds are whole
numbers and ties go by doc_id, so the result is exact. Every task carries the k best of each
query from shard to shard, so later shards are pruned by what earlier ones have found.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._text import string_column
from recollect.session import written

#: Bytes of text in a shard; bytes of queries that are searched for at once (they are sent to every task).
SHARD_BYTES, QUERY_BYTES = 8_000_000, 4_000_000
BEAM = 64
#: Impact is SCALE * tf div (1000 * tf + SATURATION * m), m the document's length against the mean, in hundredths.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 90

#: Every byte that belongs to no term becomes a space, A-Z becomes a-z; bytes from 0x80 are of letters beyond ASCII.
_KEPT = {*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_TERMS = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEPT else b if b in _KEPT else 0x20 for b in range(256))

SHARD_SCHEMA = "n_docs long, doc_ids array<long>, terms binary, counts binary, places binary, impacts binary, n_terms long, n_places long"
HIT_SCHEMA = "query int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and whatever is not ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = total = 0
        for batch in batches:
            for text in string_column(batch, "text"):
                n = len(terms_of(text.as_buffer().to_pybytes()))
                filled, total = filled + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"filled": [filled], "total": [total]})

    row = docs.select("text").mapInArrow(run, "filled long, total long").agg(F.sum("filled"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def wavelet(places: np.ndarray, docs: int) -> np.ndarray:
    """The bits of a wavelet matrix over ``places`` (numbers below ``docs``), a packed row for each level, highest bit first."""
    levels = max(1, (docs - 1).bit_length())
    rows = []
    for level in range(levels - 1, -1, -1):
        bits = (places >> level) & 1
        rows.append(np.packbits(bits.astype(np.uint8)))
        places = np.concatenate([places[bits == 0], places[bits == 1]])
    return np.array(rows)


def _shard(ids: list[int | None], texts: list[list[bytes]], n: int, total: int) -> dict | None:
    """One row of the index: documents by id (none last), postings by term and falling impact."""
    by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    lengths = np.array([len(texts[i]) for i in by], np.int64)
    tokens = np.fromiter((number(t, len(numbers)) for i in by for t in texts[i]), np.int64, int(lengths.sum()))
    if not len(tokens):
        return None
    names = sorted(numbers)
    order = np.empty(len(names), np.int64)
    order[[numbers[t] for t in names]] = np.arange(len(names))
    key, tf = np.unique(order[tokens] * len(by) + np.repeat(np.arange(len(by)), lengths), return_counts=True)
    term, doc = key // len(by), key % len(by)
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n // total
    impact = SCALE * tf // (1000 * tf + SATURATION * m[doc])
    falling = np.lexsort((doc, -impact, term))
    bits = wavelet(doc[falling], len(by))
    return {
        "n_docs": len(by),
        "doc_ids": [ids[i] for i in by],
        "terms": zstandard.ZstdCompressor(level=3).compress(b" ".join(names)),
        "counts": _pack(np.bincount(term, minlength=len(names)).astype(np.int32)),
        "places": zstandard.ZstdCompressor(level=1).compress(bits.tobytes()),
        "impacts": _pack(impact[falling].astype(np.int32)),
        "n_terms": len(names),
        "n_places": len(key),
    }


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs (doc_id, text), written under the scratch folder; ``SHARD_SCHEMA`` and the totals ``n`` and ``total``.

    Every document with a term is in it; null and empty texts have none. Rows that repeat a
    doc_id are documents of their own. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, total = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.name, pa.list_(pa.int64()) if c.name == "doc_ids" else pa.binary() if c.dataType.typeName() == "binary" else pa.int64()) for c in fields])
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), string_column(batch, "text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                own = terms_of(raw)
                if own:
                    ids.append(doc)
                    texts.append(own)
                    size += len(raw)
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([_shard(ids, texts, n, total)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(ids, texts, n, total)], schema)

    fields = docs.sparkSession.createDataFrame([], SHARD_SCHEMA).schema.fields
    shards = written(docs.mapInArrow(run, SHARD_SCHEMA), "lexical-shards")
    return shards.withColumns({"n": F.lit(n).cast("long"), "total": F.lit(total).cast("long")})


class Shard:
    """A shard to be searched: ranks of ones before each place and impacts, for each level of its wavelet matrix."""

    def __init__(self, row: dict):
        self.ids, self.docs = row["doc_ids"], row["n_docs"]
        n = row["n_places"]
        self.terms = {t: i for i, t in enumerate(zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" "))}
        self.starts = np.concatenate([[0], np.cumsum(_unpack(row["counts"], np.int32))])
        self.levels = max(1, (self.docs - 1).bit_length())
        packed = _unpack(row["places"], np.uint8).reshape(self.levels, -1)
        impacts = _unpack(row["impacts"], np.int32)
        self.ones, self.zeros, self.impacts = [], [], [np.append(impacts, 0)]
        for level in packed:
            bits = np.unpackbits(level, count=n).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            impacts = np.concatenate([impacts[~bits], impacts[bits]])
            self.impacts.append(np.append(impacts, 0))

    def search(self, weights: dict[bytes, int], k: int, best: list[tuple]) -> None:
        """Bring ``best``, a heap of (score, -place of the id, id) with the worst first, up to date with this shard."""
        found = [(self.terms[t], w) for t, w in weights.items() if t in self.terms]
        if not found:
            return
        at, w = np.array([x for x, _ in found]), np.array([x for _, x in found], np.int64)
        first, last = self.starts[at][None, :], self.starts[at + 1][None, :]
        frontier, nth, kept = [], 0, {}

        def add(level: int, nodes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            nonlocal nth
            bound = np.where(first < last, self.impacts[level][first], 0).astype(np.int64) @ w
            for i in np.flatnonzero(bound > 0).tolist():
                start = int(nodes[i]) << (self.levels - level)
                if self.may_enter(int(bound[i]), start, k, best):
                    kept[nth] = (first[i], last[i])
                    heapq.heappush(frontier, (-int(bound[i]), start, level, int(nodes[i]), nth))
                    nth += 1

        add(0, np.zeros(1, np.int64), first, last)
        while frontier:
            taken: dict[int, list] = {}
            while frontier and sum(map(len, taken.values())) < BEAM:
                bound, start, level, node, i = heapq.heappop(frontier)
                if not self.may_enter(-bound, start, k, best):
                    frontier.clear()  # no bound that is left is better
                    break
                if level == self.levels:
                    doc = self.ids[node]
                    heapq.heappush(best, (-bound, *_later(doc), doc))
                    if len(best) > k:
                        heapq.heappop(best)
                    del kept[i]
                else:
                    taken.setdefault(level, []).append((node, *kept.pop(i)))
            for level, nodes in taken.items():
                node = np.array([x[0] for x in nodes])
                first, last = np.array([x[1] for x in nodes]), np.array([x[2] for x in nodes])
                ones = self.ones[level]
                a, b = ones[first], ones[last]
                add(level + 1, node * 2, first - a, last - b)
                add(level + 1, node * 2 + 1, self.zeros[level] + a, self.zeros[level] + b)

    def may_enter(self, bound: int, start: int, k: int, best: list[tuple]) -> bool:
        """Whether a document from ``start`` on with this score would be among the best."""
        return bound > 0 and start < self.docs and (len(best) < k or (bound, *_later(self.ids[start])) > best[0][:3])


def _later(doc: int | None) -> tuple[bool, int]:
    """What is greater for an id that comes earlier; none comes last."""
    return doc is not None, -(doc or 0)


def _blocks_of_queries(queries: DataFrame, at_once: int) -> Iterator[list[tuple]]:
    """(query_id, terms) of the queries, in blocks of ``at_once`` bytes of text at most or a single query."""
    rows = queries.select("query_id", "text").where(F.octet_length("text") > 0)
    block, size, now, own = [], 0, object(), []
    for row in rows.orderBy("query_id").toLocalIterator():
        if row["query_id"] != now and own:
            block.append((now, sorted({*own})))
            if size >= at_once:
                yield block
                block, size = [], 0
            own = []
        now, size = row["query_id"], size + len(row["text"])
        own += terms_of(row["text"].encode())
    if own:
        block.append((now, sorted({*own})))
    if block:
        yield block


def _frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """The number of documents with each of the wanted terms, from the dictionaries of the shards alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" ")
                both = [(t, int(c)) for t, c in zip(names, _unpack(row["counts"], np.int32), strict=True) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in both], pa.binary()), pa.array([c for _, c in both], pa.int64())], ["term", "df"])

    found = index.select("terms", "counts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.collect()}  # at most one row for each term of a block of queries


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each of queries (query_id, text), scores above 0 only.

    A query's terms count once each, those of all rows of one query_id together; null and
    empty texts have none. A term in df of N documents weighs floor(1000 ln((2 N + 2) / (2 df + 1))),
    so one that almost every document has may weigh 0. Equal scores go by doc_id, none last.
    Queries go to the tasks in blocks of ``query_bytes``; a block is searched for in all shards.
    """
    spark = index.sparkSession
    kind = queries.schema["query_id"].dataType
    head = index.select("n").first()
    parts = []
    for block in _blocks_of_queries(queries, query_bytes) if head else ():
        df = _frequencies(index, {t for _, terms in block for t in terms})
        weigh = lambda c: math.floor(1000 * math.log((2 * head["n"] + 2) / (2 * c + 1)))
        weights = [{t: weigh(df[t]) for t in terms if t in df} for _, terms in block]
        hits = index.drop("n", "total").mapInArrow(_searched(weights, k), HIT_SCHEMA)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], ["query", "query_id"]).withColumn("query", F.col("query").cast("int"))
        parts.append(hits.join(F.broadcast(names), "query").select(F.col("query_id").cast(kind).alias("query_id"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score long").withColumn("query_id", F.col("query_id").cast(kind))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _searched(weights: list[dict[bytes, int]], k: int):
    """The k best of each query among the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in weights]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                for own, heap in zip(weights, best, strict=True):
                    shard.search(own, k, heap)
        rows = [(q, x[3], x[0]) for q, heap in enumerate(best) for x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return run
