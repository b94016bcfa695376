"""Near-duplicates by exact Jaccard similarity of shingle sets, found by prefix filtering.

Two sets of similarity ``least`` share one of the first n - ceil(least n) + 1 shingles of
each, in any order that is the same for all. The order is by document frequency, counted
over the whole corpus (see ``_ranges``), the rarest first. A shingle that one document alone
has leads nowhere, so a document with more of those than its prefix is long is out; only near
copies, or texts put together from others, meet in the buckets of their prefix shingles.

Buckets of the same documents are one. What is in a bucket is compared in full, one document
after the other with all that are not linked to it yet, so a group of near copies isn't
squared; a bucket too large for a task is split, and each two parts meet. No link between
groups is lost or invented. Equal sets are one from the start.

A SimHash radius can't do this: at similarity 0.8 fingerprints differ in 10 of 64 bits on
average and 15 or more in one pair of twenty, and a covering code for that radius has
thousands of anchors for each fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._ranges import _pack_hashes, _unpack_hashes, blocks_of, counted, counts_of, mix64, texts_of
from recollect.llm._text import LOWER_AZ, slices
from recollect.llm.components import named_groups
from recollect.session import written

SHINGLE, LEAST = 5, 0.8
#: Bytes of text in a block; bytes of shingles that are compared in a task at once.
BLOCK_BYTES, CELL_BYTES = 3_000_000, 16_000_000
#: Bytes of text that are cut to shingles at a time.
TEXTS_AT_ONCE = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def shingles(texts: list[bytes], size: int = SHINGLE, at_once: int = TEXTS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle of ``size`` words, by text, then hash; of all words if there are fewer."""
    offsets = np.cumsum([0, *map(len, texts)])
    parts = [(first, *_shingles(texts[first:last], size)) for first, last in slices(offsets, at_once)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([of + first for first, of, _ in parts]), np.concatenate([hashes for _, _, hashes in parts])


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict[bytes, int] = {}
    number, at, ends = numbers.setdefault, [], []
    for text in texts:
        at += [number(w, len(numbers)) for w in text.translate(LOWER_AZ).split()]
        ends.append(len(at))
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))[np.array(at, np.int64)]
    ends = np.array(ends, np.int64)
    lengths = np.diff(ends, prepend=0)
    starts = ends - lengths
    rolled, n = np.zeros(len(word), np.uint64), max(len(word) - size + 1, 0)
    for i in range(size):
        rolled[:n] = rolled[:n] * np.uint64(_MULTIPLIER) + word[i : i + n]
    for i in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():
        all_words = b" ".join(texts[i].translate(LOWER_AZ).split())
        rolled[starts[i]] = xxhash.xxh64_intdigest(all_words)
    count = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), count)
    hashes = mix64(rolled[np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def least_shared(n: np.ndarray | int, least: float) -> np.ndarray:
    """Shingles that a set of n shares at least with any set of that similarity."""
    return np.ceil(least * np.asarray(n) - 1e-9).astype(np.int64)


_SET_SCHEMA = "doc_id long, fp long, n int, keys array<long>, shingles binary"


def _distinct(size: int, bits: int):
    def run(row: dict) -> tuple[np.ndarray, np.ndarray]:
        _, hashes = shingles(texts_of(row), size)
        return np.unique(hashes >> np.uint64(64 - bits), return_counts=True)

    return run


def _described(size: int, least: float, bits: int):
    """A row for each document: a hash of its set, and its prefix and set if others share all of the prefix's rarest."""

    def run(answers: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        of, hashes = shingles(texts_of(row), size)
        known, place = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
        often = counts_of(answers)[0][place]
        assert len(known) == 0 or place.max() < len(known)
        ends = np.searchsorted(of, np.arange(len(row["ids"])), "right")
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        order = np.lexsort((hashes, often, of))
        first = np.arange(len(of)) - starts[of] < (n - least_shared(n, least) + 1)[of]
        chosen = order[first & (often[order] > 1)]
        chosen = np.split(hashes[chosen].view(np.int64), np.searchsorted(of[chosen], np.arange(1, len(n))))
        fp = [xxhash.xxh64_intdigest(hashes[a:b].tobytes()) - (1 << 63) for a, b in zip(starts, ends, strict=True)]
        keys = [x if len(x) else None for x in chosen]
        packed = [_pack_hashes(hashes[a:b]) if k is not None else None for k, a, b in zip(keys, starts, ends, strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "fp": pa.array(fp, pa.int64()),
                "n": pa.array(n.astype(np.int32)),
                "keys": pa.array(keys, pa.list_(pa.int64())),
                "shingles": pa.array(packed, pa.binary()),
            }
        )

    return run


def linked(fps: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects what the pairs of similarity ``least`` connect.

    From each document on, all that are reached by links: each that is reached is compared with all
    that aren't yet, at once, by marking its shingles among theirs.
    """
    n = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, sets = n[order], [sets[i] for i in order.tolist()]
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    places = [places[a:b] for a, b in zip(ends - n, ends, strict=True)]
    mark = np.zeros(int(max((x.max() for x in places if len(x)), default=-1)) + 1, bool)
    left, u, v = np.arange(len(n)), [], []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        flat, at = None, None
        while reached and len(left):
            me = reached.pop()
            if flat is None:
                flat, at = np.concatenate([places[i] for i in left.tolist()]), np.concatenate([[0], np.cumsum(n[left])])
            # those left go by size; others than these are too small or too large
            low, high = np.searchsorted(n[left], [least * n[me] - 1e-9, n[me] / least + 1e-9])
            if low == high:
                continue
            mark[places[me]] = True
            both = np.add.reduceat(mark[flat[at[low] : at[high]]].astype(np.int64), at[low:high] - at[low])
            mark[places[me]] = False
            found = np.flatnonzero(both >= least * (n[me] + n[left[low:high]] - both) - 1e-9) + low
            if len(found):
                near = left[found]
                u += [order[me]] * len(near)
                v += order[near].tolist()
                reached += near.tolist()
                left, flat = np.delete(left, found), None
    return fps[np.array(u, np.int64)], fps[np.array(v, np.int64)]


def _compared(least: float):
    def run(cell: pa.Table) -> pa.Table:
        fps, sets = cell.column("fp").to_numpy(), [_unpack_hashes(x.as_py()) for x in cell.column("shingles")]
        buckets = cell.column("buckets").combine_chunks()
        member = np.repeat(np.arange(len(fps)), np.diff(buckets.offsets.to_numpy()))
        names = buckets.flatten().to_numpy()
        order = np.argsort(names, kind="stable")
        cuts = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] - 1, append=names[order[-1]] + 1))
        edges, seen = [np.zeros((2, 0), np.int64)], set()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = np.unique(member[order[a:b]])
            if len(own) > 1 and own.tobytes() not in seen:
                seen.add(own.tobytes())
                edges.append(np.stack(linked(fps[own], [sets[i] for i in own.tolist()], least)))
        u, v = np.concatenate(edges, axis=1)
        return pa.table({"u": u, "v": v})

    return run


def links(sets: DataFrame, least: float = LEAST, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Edges (u, v) whose components are those of the link graph over the sets (fp, n, keys, shingles)."""
    entries = written(sets.select("fp", "n", F.explode("keys").alias("bucket")), "similar-entries")
    stats = entries.groupBy("bucket").agg(
        F.count("*").alias("m"),
        F.sum(F.col("n").cast("long") * 8).alias("bytes"),
        F.min("fp").alias("home"),
        F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark"),
    )
    # of buckets of the same documents one is enough
    stats = stats.where("m > 1").groupBy("m", "mark", "home").agg(F.min("bucket").alias("bucket"), F.min("bytes").alias("bytes"))
    stats = written(stats.select("bucket", "home", F.ceil(F.col("bytes") / cell_bytes).cast("int").alias("parts"), "bytes"), "similar-buckets")
    small = stats.agg(F.sum(F.when(F.col("parts") == 1, F.col("bytes")))).first()[0] or 0
    cells = int(small // cell_bytes) * 4 + 16
    part = F.pmod(F.xxhash64("fp", "bucket"), F.col("parts"))
    row = entries.join(stats, "bucket").withColumn("part", part)
    # part i meets each part j: in cell (i, j) or (j, i), the smaller first
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    row = row.withColumn("other", other).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    alone = F.pmod(F.xxhash64("home"), F.lit(cells))
    cell = F.when(F.col("parts") == 1, alone).otherwise(F.xxhash64("bucket", "a", "b"))
    # buckets that begin with the same document meet in one cell, where each set is needed once
    met = row.select(cell.alias("cell"), "fp", "bucket").groupBy("cell", "fp").agg(F.collect_set("bucket").alias("buckets"))
    full = met.join(sets.select("fp", "shingles"), "fp")
    return full.groupBy("cell").applyInArrow(_compared(least), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is
    ``least`` or more. fp is a hash of the set; component_id is the smallest doc_id of the
    group, itself included. Null texts count as empty, and empty texts are equal to each
    other. Null doc_ids never name a group unless it has nothing else. Repeated rows keep a
    row each. Other columns are not read. No documents: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, net = blocks_of(docs, block_bytes, 1)
    answers = counted(blocks, _distinct(size, net.bits), net)
    described = answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_described(size, least, net.bits), _SET_SCHEMA)
    rows = written(described, "similar-sets")
    sets = written(rows.where("keys IS NOT NULL").select("fp", "n", "keys", "shingles").dropDuplicates(["fp"]), "similar-distinct")
    return named_groups(rows.select("doc_id", "fp"), written(links(sets, least, cell_bytes), "similar-links"))
