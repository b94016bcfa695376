"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector and a document's fingerprint is the sum of
its paragraphs' vectors: STRONG lanes of a cryptographic hash modulo 2^64, which tell
multisets of paragraphs apart, and lanes modulo 2^16 that count the paragraph's byte
windows, which tell how alike two documents are. Those lanes are WIDTH at each of LEVELS
levels; a level has a quarter of the windows of the one before, by their hashes. Documents
are compared at the finest level that is not crowded, by which lanes are not zero, so a
line that occurs a hundred times counts like one that occurs once, whatever is long.
The order of paragraphs doesn't matter, and paragraphs are inserted and deleted by adding
and subtracting their vectors, without the rest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import slices, string_column

STRONG, LEVELS, WIDTH = 8, 10, 128
LANES = LEVELS * WIDTH
#: Bytes of a window; those of lines under SHORT bytes, which have few others.
WINDOW, SHORT_WINDOW, SHORT = 8, 3, 40
#: Share of the lanes of a level up to which distinct windows, and occurrences, are read from it.
CROWDED, SPARSE = 0.8, 0.3
#: Bytes of text hashed at a time, a document taken for DOC_BYTES at least; bytes of a range of documents.
SLICE_BYTES, DOC_BYTES, CELL_BYTES = 1_000_000, 1_000, 128_000_000


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Fingerprints:
    """Fingerprints of several documents: ``strong`` uint64 (n, STRONG), ``lanes`` uint16 (n, LANES)."""

    def __init__(self, strong: np.ndarray, lanes: np.ndarray):
        self.strong, self.lanes = strong, lanes

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.strong + other.strong, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.strong - other.strong, self.lanes - other.lanes)

    def __getitem__(self, at) -> Fingerprints:
        return Fingerprints(self.strong[at], self.lanes[at])

    def joined(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(np.concatenate([self.strong, other.strong]), np.concatenate([self.lanes, other.lanes]))

    def hex(self) -> list[str]:
        both = np.concatenate([self.strong.astype(">u8").view(np.uint8), self.lanes.astype(">u2").view(np.uint8)], axis=1)
        text, width = both.tobytes().hex(), 2 * both.shape[1]
        return [text[i : i + width] for i in range(0, len(text), width)]

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """Twice the windows that both have by the sum of each one's, as the lanes show it; 1 for equal fingerprints.

        Of distinct windows or of all occurrences, whichever is more: a line that is repeated
        outweighs the rest in one, and what is said once outweighs a page of one word in the other.
        """
        a, b = (x.lanes.reshape(-1, LEVELS, WIDTH) for x in (self, other))
        row, all_ = np.arange(len(a)), ((a | b) > 0).sum(axis=2)
        fine = all_ <= CROWDED * WIDTH
        level = np.where(fine.any(axis=1), fine.argmax(axis=1), LEVELS - 1)
        # so many distinct windows leave so many lanes at zero
        counts = ((a[row, level] > 0).sum(axis=1), (b[row, level] > 0).sum(axis=1), all_[row, level])
        own, its, both = (-np.log1p(-np.minimum(x, WIDTH - 0.5) / WIDTH) for x in counts)
        distinct = np.divide(2 * (own + its - both), own + its, out=np.zeros(len(own)), where=own + its > 0)
        # occurrences where few lanes have several windows
        fine = all_ <= SPARSE * WIDTH
        level = np.where(fine.any(axis=1), fine.argmax(axis=1), LEVELS - 1)
        own, its = (x[row, level].astype(np.int64) for x in (a, b))
        sums = own.sum(axis=1) + its.sum(axis=1)
        occurring = np.divide(2 * np.minimum(own, its).sum(axis=1), sums, out=np.zeros(len(own)), where=sums > 0)
        equal = (self.strong == other.strong).all(axis=1) & (self.lanes == other.lanes).all(axis=1)
        return np.where(equal, 1.0, np.clip(np.maximum(distinct, occurring), 0.0, 1.0))


def _counted(lanes: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> None:
    """Add windows to the lanes (n, LANES) of their documents, at each level that they are on."""
    n = len(lanes)
    for level in range(LEVELS):
        cell = owner * LANES + level * WIDTH + (hashes >> np.uint64(57)).astype(np.int64)
        lanes += np.bincount(cell, minlength=n * LANES).reshape(n, LANES)
        on = (hashes >> np.uint64(2 * level)) & np.uint64(3) == 0
        hashes, owner = hashes[on], owner[on]
        if not len(hashes):
            return


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, owners) of the windows of ``size`` bytes in the lines [starts, ends), about SLICE_BYTES at a time."""
    # a longer line is cut into pieces that overlap by a window less one
    pieces = np.maximum(-(-(ends - starts - size + 1) // SLICE_BYTES), 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, whole, owner = np.repeat(starts, pieces) + nth * SLICE_BYTES, np.repeat(ends, pieces), np.repeat(owner, pieces)
    count = np.maximum(np.minimum(whole - starts - size + 1, SLICE_BYTES), 0)
    for lo, hi in slices(np.concatenate([[0], np.cumsum(count)]), SLICE_BYTES):
        of = np.repeat(np.arange(lo, hi), count[lo:hi])
        at = np.arange(len(of)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi]) + starts[of]
        value = np.full(len(at), size, np.uint64)
        for i in range(size):
            value = (value << np.uint64(8)) ^ data[at + i]
        yield _mix64(value), owner[of]


def fingerprints(texts: list[bytes]) -> Fingerprints:
    """The fingerprint of each UTF-8 text, the sum over its lines."""
    n = len(texts)
    strong, lanes = np.zeros((n, STRONG), np.uint64), np.zeros((n, LANES), np.uint16)
    offsets = np.concatenate([[0], np.cumsum([len(t) + DOC_BYTES for t in texts])]).astype(np.int64)
    for first, last in slices(offsets, SLICE_BYTES):
        lines, owner = [], []
        for i in range(first, last):
            own = texts[i].split(b"\n")
            lines += own
            owner.append(len(own))
        digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8 * STRONG).digest() for x in lines), "<u8").reshape(-1, STRONG)
        counts = np.array(owner)
        strong[first:last] = np.add.reduceat(digests, np.cumsum(counts) - counts, axis=0)
        data = np.frombuffer(b"\n".join(lines), np.uint8)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        of = np.repeat(np.arange(last - first), counts)
        sums = np.zeros((last - first, LANES), np.int64)
        for size, inside in ((WINDOW, lengths >= WINDOW), (SHORT_WINDOW, (lengths >= SHORT_WINDOW) & (lengths < SHORT))):
            for hashes, owners in _windows(data, starts[inside], ends[inside], of[inside], size):
                _counted(sums, hashes, owners)
        tiny = np.flatnonzero(lengths < SHORT_WINDOW)
        _counted(sums, _mix64(digests[tiny, 0]), of[tiny])
        lanes[first:last] = sums.astype(np.uint16)
    return Fingerprints(strong, lanes)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``after``."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _edit(text: str, after: str) -> tuple[str, str, str]:
    """(the edited text, the paragraphs that go, the paragraphs that come)."""
    new = edited(text, after)
    cut = text.rfind("\n", 0, len(text) - len(text) // 3) + 1
    return new, text[cut:], new[cut:]


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, by cell; each is compared with the row after it in its cell."""
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
    ids, cells, tails, texts, made = [], [], [], [], Fingerprints(np.zeros((0, STRONG), np.uint64), np.zeros((0, LANES), np.uint16))
    for batch in batches:
        column = string_column(batch, "text")
        size = np.cumsum(np.concatenate([[0], np.asarray(pa.compute.binary_length(column)) + DOC_BYTES]))
        for lo, hi in slices(size, 4 * SLICE_BYTES):
            new = column.slice(lo, hi - lo).to_pylist()
            ids += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            cells += batch.column("cell").slice(lo, hi - lo).to_pylist()
            tails += batch.column("tail").slice(lo, hi - lo).to_pylist()
            texts += new
            made = made.joined(fingerprints([t.encode() for t in new]))
            pairs = [i for i in range(len(ids) - 1) if cells[i] == cells[i + 1] and not tails[i]]
            if pairs:
                changes = [_edit(texts[i], texts[i + 1]) for i in pairs]
                own, after = made[pairs], made[[i + 1 for i in pairs]]
                gone, come = (fingerprints([x[k].encode() for x in changes]) for k in (1, 2))
                other = own - gone + come
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in pairs], pa.int64()),
                        pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in changes]),
                        pa.array(own.hex()),
                        pa.array(other.hex()),
                        pa.array(own.likeness(other)),
                        pa.array(own.likeness(after)),
                    ],
                    names,
                )
            ids, cells, tails, texts, made = ids[-1:], cells[-1:], tails[-1:], texts[-1:], made[-1:]


def _cell_of(bounds: list[float]):
    highest_first = np.array(sorted(set(bounds)))

    @F.pandas_udf("int")
    def cell(doc_id: pd.Series) -> pd.Series:
        below = len(highest_first) - np.searchsorted(highest_first, doc_id.fillna(-(2**62)).to_numpy(float), "right")
        return pd.Series(below, dtype="int32")

    return cell


def compare_with_next(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """Fingerprint each text, the text edited with the next document's, and compare; see EDIT_SCHEMA.

    The next document is the one after in the order of falling doc_id (null last), equal
    ids by text; after the last comes the first. Null texts count as empty; repeated rows
    keep a row each; a lone document is its own next. Other columns are not read. No
    documents: no rows.

    Documents are dealt by ranges of doc_id, so texts are shuffled once; the first document
    of each range also goes, as a tail, to the range before. ``cells`` ranges, by default one
    for each CELL_BYTES of text and as many as shuffle partitions at least, bound what the
    driver sees: one id each. Rows of one doc_id, or of none, are in one range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if cells is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CELL_BYTES))
    inner = [i / cells for i in range(1, cells)]
    quantiles = inner and docs.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", inner, 0.2 / cells)
    cell = _cell_of(quantiles or [0.0])
    heads = docs.groupBy(cell("doc_id").alias("cell")).agg(F.max("doc_id").alias("head")).orderBy("cell").collect()
    before = {r["head"]: heads[i - 1]["cell"] for i, r in enumerate(heads)}
    tails = spark.createDataFrame(list(before.items()), "head long, cell int")
    first = docs.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("doc_id", "cell").agg(F.min("text").alias("text")).select("doc_id", "text", "cell", F.lit(True).alias("tail"))
    rows = docs.withColumn("cell", cell("doc_id")).withColumn("tail", F.lit(False)).unionByName(first)
    rows = rows.repartitionById(cells + 1, F.col("cell")).sortWithinPartitions("cell", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(_compare, EDIT_SCHEMA)
