"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits in a few blocks. Two that differ in t bits at most differ in
t / blocks at most within some block. A block's anchors are the words of a covering code: a
perfect Hamming code over its first bits times all values of its other bits, so every value
lies within radius 1 of an anchor. A fingerprint probes at its own anchor and is replicated
to every anchor within radius 1 + t / blocks: whatever is linked to it probes at one of
those. Fingerprints are compared per anchor only, in full, so no link is lost or invented.
Three blocks make few replicas; far more fingerprints take two blocks, with more replicas
but so many more anchors that less is compared (see CODES).

Equal fingerprints are one, whatever their number of documents. A task sends what it knows
of an anchor cell as one packed row. An anchor with very many probes becomes a grid: its
probes are dealt to rows, its replicas to columns, and each meets in the cells of its own.
A cell gives out a spanning star per connected group instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import LOWER_AZ, fresh, string_column
from recollect.llm.components import components, named_groups  # noqa: F401
from recollect.session import written

THRESHOLD, SHINGLE, SEED = 4, 4, 42
RADIUS = 1
#: Shingles turned to bits at a time; pairs compared at a time.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 65_536, 2_000_000
#: Replicas in an anchor cell; probes of one anchor beyond which it is a grid; most anchors that are.
CELL_ROWS, HOT_PROBES, MOST_HOT = 400_000, 20_000, 50_000


@dataclass(frozen=True)
class Code:
    """The bits of each block, and how many of its first bits the Hamming code is over (15 or 31)."""

    blocks: tuple[int, ...]
    length: int

    def replicas(self, threshold: int) -> int:
        """Of each fingerprint, on average and rounded up."""
        return 1 + sum(sum(map(len, masks)) // (self.length + 1) for masks in map(self.masks(threshold), self.blocks))

    def masks(self, threshold: int):
        return lambda bits: _masks(bits, RADIUS + threshold // len(self.blocks), self.length)


#: From so many distinct fingerprints on: 45 replicas at 2^19 anchors, 350 at 2^28.
CODES = ((0, Code((21, 21, 22), 15)), (300_000_000, Code((32, 32), 31)))


def code_for(n: int) -> Code:
    """The code for n distinct fingerprints."""
    return [code for least, code in CODES if n >= least][-1]


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; of all words if there are fewer."""
    words = text.translate(LOWER_AZ).split()
    joined, n = b" ".join(words), len(words)
    if n <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if n else []
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[i : i + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def simhash(text: bytes) -> int:
    """Bit i is set if it is in over half of the shingle hashes; 0 without words. Unsigned."""
    hashes = np.array(shingle_hashes(text), np.uint64)
    bits = 2 * _bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = string_column(batch, "text")
        made = np.fromiter((simhash(t.as_buffer().to_pybytes()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. A null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


@cache
def _masks(bits: int, radius: int, length: int) -> list[np.ndarray]:
    """By syndrome: the error patterns of weight up to ``radius`` that lead from a block value to an anchor."""
    out: list[list[int]] = [[] for _ in range(length + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < length else 0
            out[syndrome].append(sum(1 << p for p in places))
    return [np.array(x, np.uint64) for x in out]


def _syndromes(values: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for r in range(length.bit_length()):
        checked = sum(1 << p for p in range(length) if (p + 1) >> r & 1)
        out |= (np.bitwise_count(values & np.uint64(checked)).astype(np.int64) & 1) << r
    return out


def anchors(fps: np.ndarray, threshold: int = THRESHOLD, code: Code = CODES[0][1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor keys, index of the fingerprint, whether it is its own anchor) for unsigned fingerprints.

    Own anchors are the nearest ones: an index has one in each block.
    """
    keys, index, own = [], [], []
    shift = 0
    for block, bits in enumerate(code.blocks):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        shift += bits
        syndrome = _syndromes(value, code.length)
        for s, masks in enumerate(code.masks(threshold)(bits)):
            rows = np.flatnonzero(syndrome == s)
            nearest = np.uint64(0 if s == 0 else 1 << (s - 1))
            keys.append(((value[rows][:, None] ^ masks) | np.uint64(block << 32)).ravel())
            index.append(np.repeat(rows, len(masks)))
            own.append(np.tile(masks == nearest, len(rows)))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(own)


def own_anchors(fps: np.ndarray, code: Code) -> np.ndarray:
    """The nearest anchors alone, one in each block."""
    keys, shift = [], 0
    for block, bits in enumerate(code.blocks):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        shift += bits
        syndrome = _syndromes(value, code.length)
        flip = np.where(syndrome == 0, 0, 1 << np.maximum(syndrome - 1, 0)).astype(np.uint64)
        keys.append((value ^ flip) | np.uint64(block << 32))
    return np.concatenate(keys)


def _own_anchors(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = own_anchors(batch.column("fp").to_numpy().view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["anchor"])

    return run


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Replicas that are made at a time.
REPLICAS_AT_ONCE = 500_000


def _in_grids(keys: np.ndarray, of: np.ndarray, own: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, fingerprints, whether they probe, cell of the grid) of rows whose anchors are grids of ``sides`` squared."""
    mixed = _mix64(of)
    row = (mixed % sides.astype(np.uint64)).astype(np.int64)
    column = ((mixed >> np.uint64(32)) % sides.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), sides)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(sides) - sides, sides)
    # a replica goes to all cells of its column, in its own row as the probe too, a probe to all of its row
    down = nth * sides[at] + column[at], own[at] & (nth == row[at])
    along = row[at] * sides[at] + nth, own[at]
    more = own[at] & (nth != column[at])
    at, cell, probes = np.concatenate([at, at[more]]), np.concatenate([down[0], along[0][more]]), np.concatenate([down[1], along[1][more]])
    return keys[at], of[at], probes, cell


def _replicas(cells: int, hot: dict[int, int], threshold: int, code: Code):
    """Rows (cell, keys, fps, own) of packed arrays, one for each cell that a batch reaches."""
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_sides = np.array([hot[int(k)] for k in hot_keys], np.int64)

    def packed(fps: np.ndarray) -> pa.RecordBatch:
        keys, index, own = anchors(fps, threshold, code)
        of, salt = fps[index], np.zeros(len(keys), np.uint64)
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
            is_hot = hot_keys[at] == keys
            *grid, place = _in_grids(keys[is_hot], of[is_hot], own[is_hot], hot_sides[at[is_hot]])
            keys, of, own = (np.concatenate([x[~is_hot], y]) for x, y in zip((keys, of, own), grid, strict=True))
            salt = np.concatenate([salt[~is_hot], place.astype(np.uint64)])
        cell = (_mix64(keys + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, keys, of, own, salt = cell[order], keys[order], of[order], own[order], salt[order]
        cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        keyed = keys | (salt << np.uint64(36))
        parts = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (keyed, of, own)]
        return pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]]), *(pa.array(p, pa.binary()) for p in parts)], ["cell", "keys", "fps", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, REPLICAS_AT_ONCE // code.replicas(threshold))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), step):
                yield packed(fps[i : i + step])

    return run


def star(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its group), without self-loops, for the graph of edges u-v over n nodes."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not (label == label[label]).all():
            label = label[label]
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def compare(keys: np.ndarray, fps: np.ndarray, own: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between probes and replicas of the same anchor."""
    nodes, node = np.unique(fps, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    keys, node, own = keys[order], node[order], own[order]
    probe = np.flatnonzero(own)
    low, high = np.searchsorted(keys, keys[probe], "left"), np.searchsorted(keys, keys[probe], "right")
    upto = np.concatenate([[0], np.cumsum(high - low)])
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = 0
    while a < len(probe):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS_AT_ONCE, "right")) - 1)
        count = high[a:b] - low[a:b]
        left = np.repeat(node[probe[a:b]], count)
        right = node[np.arange(upto[b] - upto[a]) + np.repeat(low[a:b] - (upto[a:b] - upto[a]), count)]
        close = (np.bitwise_count(nodes[left] ^ nodes[right]) <= threshold) & (left != right)
        if close.any():
            u, v = star(np.concatenate([u, left[close]]), np.concatenate([v, right[close]]), len(nodes))
        a = b
    return nodes[u], nodes[v]


def _compare_cell(threshold: int):
    def run(cell: pa.Table) -> pa.Table:
        keys, fps, own = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in cell.column(name)])
            for name, kind in (("keys", np.uint64), ("fps", np.uint64), ("own", bool))
        )
        u, v = compare(keys, fps, own, threshold)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, cell_rows: int = CELL_ROWS, hot_probes: int = HOT_PROBES, code: Code | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of the link graph over the distinct values of fp.

    The anchors that are grids are known to all tasks. They are MOST_HOT at most, as no more
    anchors can have more than a MOST_HOT-th of all probes.
    """
    n = fps.count()
    code = code or code_for(n)
    hot_probes = max(hot_probes, len(code.blocks) * n // MOST_HOT)
    own = fps.select("fp").mapInArrow(_own_anchors(code), "anchor long").groupBy("anchor").count()
    hot = {r["anchor"]: -(-r["count"] // hot_probes) for r in own.where(F.col("count") > hot_probes).collect()}
    cells = max(1, -(-code.replicas(threshold) * n // cell_rows))
    packed = fps.select("fp").mapInArrow(_replicas(cells, hot, threshold, code), "cell long, keys binary, fps binary, own binary")
    return packed.groupBy("cell").applyInArrow(_compare_cell(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    component_id is the smallest doc_id in the document's group, itself included. Null
    texts count as empty; empty texts have fingerprint 0, which links like any other. Null
    doc_ids take part but never name a group unless it has nothing else (then it is null).
    Repeated rows keep a row each. Other columns are not read. No documents: no rows.
    """
    docs_fp = written(fingerprints(docs), "simhash")
    fps = written(docs_fp.select("fp").distinct(), "simhash-distinct")
    return named_groups(docs_fp, written(links(fps, threshold), "simhash-links"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, found: DataFrame | None = None) -> DataFrame:
    """The documents that name their group: one of each, columns unchanged.

    ``found`` has the groups (doc_id, component_id) if they are others than near_duplicates gives.
    Rows of one doc_id with equal texts count as one document; with other texts each is
    judged by the groups that their doc_id names.
    """
    found = near_duplicates(docs, threshold) if found is None else found
    key, text = fresh(docs, "_key", "_text")
    # a key without nulls serves the join and the removal of repeated rows with one shuffle
    made = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    winners = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(made.alias(key)).distinct()
    kept = docs.withColumn(key, made).withColumn(text, F.xxhash64("text")).join(winners, key, "left_semi")
    return kept.dropDuplicates([key, text]).drop(key, text)
