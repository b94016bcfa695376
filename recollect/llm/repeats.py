"""Suffix-array dedup: maximal repeats across documents and the text without what repeats.

A suffix array of a whole corpus fits no machine, so it is built in parts that hold all that
can match. Of the grams of ``GRAM`` bytes in a window of ``LENGTH`` bytes the one with the least
hash, the leftmost of equals, is its anchor: equal windows have equal anchors at the same
place. Consecutive windows with one anchor are a segment, about a third of a window long and
the window; equal windows are in segments of the same anchor, wherever these are.

Segments that are equal as a whole are one entry of the suffix array with several
occurrences (``_firsts`` tells the blocks which is the first). Where an anchor has one such
entry, that is a repeat group itself. Where it has more, the entries meet in a bin; the
suffixes that are long enough are sorted, and a stack scan of their common prefixes visits
the intervals of the lcp tree. An interval whose suffixes have different letters to their
left is a maximal repeat, all its suffixes are the occurrences, and all but the first go.
Other intervals are part of a longer repeat that starts further left, so nothing is lost.

An anchor of over ``HOT`` segments would make a bin too large; windows of those are asked
about by their own hashes instead, block by block, which gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._firsts import answers_of, firsts
from recollect.llm._ranges import Network, blocks_of, mix64, texts_of
from recollect.llm._text import distinct
from recollect.session import written

LENGTH, GRAM = 100, 32
BLOCK_BYTES, HOT = 4_000_000, 5_000
#: Bytes of text that are hashed at once, and bytes of the corpus for each bin of segments.
CHUNK_BYTES, BIN_BYTES = 4_500_000, 2_000_000
_LAST = np.iinfo(np.int64).max  # no doc_id comes last

FOUND_SCHEMA = "block long, kind string, bin long, doc long, segment long, start long, whole long, spans binary, data binary"
COVER_SCHEMA = "block long, spans binary"
GROUP_SCHEMA = "repeat long, length long, segment long, offset long"


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least_in_window(order: np.ndarray, size: int) -> np.ndarray:
    """The place of the least of each ``size`` consecutive values, the leftmost of equals."""
    place, reach = np.arange(len(order), dtype=np.int32), 1
    while reach < size:
        step = min(reach, size - reach)
        a, b = order[:-step], order[step:]
        left = a <= b
        order = np.where(left, a, b)
        place = np.where(left, place[:-step], place[step:])
        reach += step
    return place


class Segments:
    """The segments of a block: document (its number in the block), first and last window start, anchor; hashes of both."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.data = length, b"".join(texts)
        ends = np.cumsum([len(x) for x in texts]).astype(np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.ones(len(raw), bool)
        for size, end in zip(map(len, texts), ends.tolist(), strict=True):
            inside[max(end - size, end - length + 1) : end] = False
        starts, lasts, anchors = [], [], []
        for at in range(0, max(0, len(raw) - length + 1), CHUNK_BYTES):
            part = raw[at : at + CHUNK_BYTES + length - 1]
            if len(part) < length:
                break
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[part] * _powers(_BASE, len(part)), dtype=np.uint64)])
            grams = mix64((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, len(part) - gram + 1))
            place = _least_in_window((grams >> np.uint64(32)).astype(np.uint32), length - gram + 1).astype(np.int64) + at
            start = np.flatnonzero(inside[at : at + len(place)])
            place = place[start]
            start = start + at
            if len(start):
                # texts are apart by the places where no window fits
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
                starts.append(start[new])
                lasts.append(start[np.append(new[1:], len(start)) - 1])
                anchors.append(place[new])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.first, self.last, anchor = join(starts), join(lasts), join(anchors)
        self.doc = np.searchsorted(ends, self.first, "right")
        self.base = (ends - np.diff(ends, prepend=0))[self.doc] if len(ends) else self.first
        view, digest, n = memoryview(self.data), xxhash.xxh64_intdigest, len(self.first)
        of_anchor = np.fromiter((digest(view[a : a + gram]) for a in anchor.tolist()), np.uint64, n)
        of_text = np.fromiter((digest(view[a : b + length], c) for a, b, c in zip(self.first.tolist(), self.last.tolist(), (anchor - self.first).tolist(), strict=True)), np.uint64, n)
        # the lowest bit tells the two apart
        self.anchors, self.hashes = of_anchor | np.uint64(1), of_text & ~np.uint64(1)

    def text(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i] + self.length]


def _ids(row: dict) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in row["ids"]], np.int64)


def _smallest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their numbers, the smallest document of each)."""
    by = np.lexsort((docs, hashes))
    hashes, docs = hashes[by], docs[by]
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], np.diff(np.append(new, len(hashes))), docs[new]


def _distinct(length: int, gram: int):
    def run(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = Segments(texts_of(row), length, gram)
        docs = _ids(row)[own.doc]
        return _smallest(np.concatenate([own.anchors, own.hashes]), np.concatenate([docs, docs]))

    return run


def _found(length: int, gram: int, bins: int, hot: int, occurrences: bool):
    """What a block knows after the answers, as rows of FOUND_SCHEMA by kind.

    cover: spans (document, start, stop) that go; entry: a segment for the suffix array;
    hot: segments of hot anchors; seen: every occurrence of a repeated segment.
    """

    def run(answers: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block, ids = row["block"], _ids(row)
        own = Segments(texts_of(row), length, gram)
        counts, first = answers_of(answers)
        hashes = distinct(np.concatenate([own.anchors, own.hashes]))
        of_anchor, of_text = counts[np.searchsorted(hashes, own.anchors)], np.searchsorted(hashes, own.hashes)
        docs, start, stop = ids[own.doc], own.first - own.base, own.last - own.base + length
        # of equal segments in this block the first, if this block has the first of all
        by = np.lexsort((start, own.doc, docs, own.hashes))
        head = np.zeros(len(by), bool)
        if len(by):
            head[by[np.concatenate([[True], own.hashes[by][1:] != own.hashes[by][:-1]])]] = True
        head &= first[of_text]
        again = counts[of_text] > 1
        mixed = head & (of_anchor > counts[of_text])
        rows = []
        spans = lambda at: np.stack([own.doc[at], start[at], stop[at]], axis=1).astype(np.int64).tobytes()
        if len(at := np.flatnonzero(~head & again)):
            rows.append((block, "cover", *[None] * 5, spans(at), None))
        if len(at := np.flatnonzero(mixed & (of_anchor > hot))):
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(own.text(i) for i in at.tolist()))
            whole = np.concatenate([np.frombuffer(spans(at), np.int64).reshape(-1, 3), docs[at][:, None]], axis=1)
            rows.append((block, "hot", *[None] * 5, whole.tobytes(), data))
        for i in np.flatnonzero(mixed & (of_anchor <= hot)).tolist():
            rows.append((block, "entry", int(own.anchors[i] % np.uint64(bins)), int(docs[i]), _signed(own.hashes[i]), None, None, spans([i]), own.text(i)))
        if occurrences:
            for i in np.flatnonzero(again | mixed).tolist():
                key = None if docs[i] == _LAST else int(docs[i])
                size = int(stop[i] - start[i]) if again[i] else None
                rows.append((block, "seen", None, key, _signed(own.hashes[i]), int(start[i]), size, None, None))
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
        names = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]
        return pa.table({n: pa.array([r[j] for r in rows], k) for j, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def _signed(x: np.uint64) -> int:
    return int(x.astype(np.int64))


def common_prefixes(texts: list[bytes], suffixes: list[bytes], order: list[int]) -> np.ndarray:
    """The length of the common prefix of each suffix with the one before in the order; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    width = max(map(len, suffixes), default=0)
    lengths = np.array([len(suffixes[i]) for i in order], np.int64)
    for at in range(1, len(order), 20_000):
        to = min(at + 20_000, len(order))
        joined = b"".join(suffixes[i].ljust(width, b"\0") for i in order[at - 1 : to])
        letters = np.frombuffer(joined, np.uint8).reshape(-1, width)
        differ = letters[1:] != letters[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[at:to] = np.minimum(same, np.minimum(lengths[at:to], lengths[at - 1 : to - 1]))
    return lcp


def maximal_repeats(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last place) of the intervals of a suffix array that can't be extended to either side.

    lcp: the common prefix of each suffix with the one before; left: the letter before each
    suffix, -1 where there is none to compare. Only intervals of ``least`` letters and more.
    """
    stack: list[list[int]] = []  # length, first place, the letter to the left of all so far or -1
    for i in range(1, len(lcp) + 1):
        value = lcp[i] if i < len(lcp) else 0
        value = value if value >= least else 0
        start, letter = i - 1, left[i - 1]
        while stack and stack[-1][0] > value:
            length, start, before = stack.pop()
            letter = letter if before == letter else -1
            if letter < 0:
                yield length, start, i - 1
        if value:
            if stack and stack[-1][0] == value:
                top = stack[-1]
                top[2] = top[2] if top[2] == letter else -1
            else:
                stack.append([value, start, letter])


def _scan(table: pa.Table, length: int) -> tuple[list[bytes], list[tuple[int, int]], list[int], Iterator[tuple[int, int, int]]]:
    """(entries, (entry, offset) by suffix, suffix array, maximal repeats in it) of a bin."""
    texts = [x.as_py() for x in table.column("data")]
    of = [(i, j) for i, text in enumerate(texts) for j in range(len(text) - length + 1)]
    suffixes = [texts[i][j:] for i, j in of]
    order = sorted(range(len(of)), key=suffixes.__getitem__)
    lcp = common_prefixes(texts, suffixes, order)
    left = [texts[i][j - 1] if j else -1 for i, j in (of[k] for k in order)]
    return texts, of, order, maximal_repeats(lcp.tolist(), left, length)


def _covered(length: int):
    """COVER_SCHEMA of the entries of a bin: of each maximal repeat all occurrences but the first."""

    def run(table: pa.Table) -> pa.Table:
        spans = np.frombuffer(b"".join(x.as_py() for x in table.column("spans")), np.int64).reshape(-1, 3)
        doc, block = table.column("doc").to_numpy(), table.column("block").to_numpy()
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((spans[:, 1], spans[:, 0], block, doc))] = np.arange(len(doc))
        texts, of, order, repeats = _scan(table, length)
        start, stop = np.full(len(texts), _LAST), np.full(len(texts), -1)
        for size, a, b in repeats:
            members = [of[k] for k in order[a : b + 1]]
            first = min(members, key=lambda x: (rank[x[0]], x[1]))
            for x in members:
                if x != first:
                    start[x[0]], stop[x[0]] = min(start[x[0]], x[1]), max(stop[x[0]], x[1] + size)
        # windows of one segment overlap, so what goes of it is one span
        at = np.flatnonzero(stop > 0)
        gone = np.stack([spans[at, 0], spans[at, 1] + start[at], spans[at, 1] + stop[at]], axis=1)
        return pa.table({"block": pa.array(block[at], pa.int64()), "spans": pa.array([x.tobytes() for x in gone], pa.binary())})

    return run


def _windows(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, hash) of each window of a block's hot segments."""
    spans = np.frombuffer(row["spans"], np.int64).reshape(-1, 4)
    view = memoryview(zstandard.ZstdDecompressor().decompress(row["data"]))
    sizes = spans[:, 2] - spans[:, 1]
    at = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    digest = xxhash.xxh64_intdigest
    return of, offset, np.fromiter((digest(view[a : a + length]) for a in (at[of] + offset).tolist()), np.uint64, len(of))


def _hot_covered(length: int):
    def run(answers: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        spans = np.frombuffer(row["spans"], np.int64).reshape(-1, 4)
        of, offset, hashes = _windows(row, length)
        counts, first = answers_of(answers)
        place = np.searchsorted(distinct(hashes), hashes)
        by = np.lexsort((spans[of, 1] + offset, spans[of, 0], spans[of, 3], hashes))
        head = np.zeros(len(by), bool)
        head[by[np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])]] = True
        at = np.flatnonzero(~(head & first[place]) & (counts[place] > 1))
        gone = np.stack([spans[of[at], 0], spans[of[at], 1] + offset[at], spans[of[at], 1] + offset[at] + length], axis=1)
        return pa.table({"block": pa.array([row["block"]], pa.int64()), "spans": pa.array([gone.astype(np.int64).tobytes()], pa.binary())})

    return run


KEPT_SCHEMA = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def _without(covers: pa.Table, table: pa.Table) -> pa.Table:
    """The documents of a block without their covered bytes."""
    row = table.to_pylist()[0]
    data = zstandard.ZstdDecompressor().decompress(row["data"])
    ends = np.frombuffer(row["ends"], np.int64)
    starts = ends - np.diff(ends, prepend=0)
    gone = np.frombuffer(b"".join(x.as_py() for x in covers.column("spans")), np.int64).reshape(-1, 3)
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, starts[gone[:, 0]] + gone[:, 1], 1)
    np.add.at(steps, starts[gone[:, 0]] + gone[:, 2], -1)
    removed, raw = np.cumsum(steps[:-1]) > 0, np.frombuffer(data, np.uint8)
    spans, kept = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out = removed[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]))).reshape(-1, 2)
        spans.append([{"start": x, "stop": y} for x, y in edges.tolist()])
        kept.append(raw[a:b][~out].tobytes() if len(edges) else data[a:b])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(ends - starts), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def _entries(docs: DataFrame, length: int, gram: int, block_bytes: int, hot: int, fan: int | None, occurrences: bool = False) -> tuple[DataFrame, DataFrame, Network]:
    """(blocks, FOUND_SCHEMA, written, the network of exchanges)."""
    if gram >= length:
        raise ValueError("grams have to be shorter than repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, net = blocks_of(docs, block_bytes, 1)
    net = Network.of(net.ranges, 64, *([fan] if fan else []))
    answers = firsts(blocks, _distinct(length, gram), net)
    bins = max(1, net.ranges * block_bytes // BIN_BYTES)
    found = answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_found(length, gram, bins, hot, occurrences), FOUND_SCHEMA)
    return blocks, written(found, "repeat-entries"), net


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, fan: int | None = None) -> DataFrame:
    """Each document without the bytes covered by a ``length``-byte string that also starts earlier; KEPT_SCHEMA.

    Earlier is a smaller doc_id, or the same document and a smaller start; no doc_id comes
    last, and rows of one doc_id are in the order they are packed in. Strings may overlap and
    are judged on the texts as they came. spans are the maximal runs of bytes that went, kept
    is what stays, which may cut a letter of several bytes. Null texts are empty; texts
    under ``length`` stay whole; no documents, no rows; other columns are not read. Segments
    and windows are compared as hashes of 63 and 64 bits where they aren't sorted.
    """
    blocks, found, net = _entries(docs, length, gram, block_bytes, hot, fan)
    covers = found.where("kind = 'cover'").select("block", "spans")
    entries = found.where("kind = 'entry'")
    covers = covers.unionByName(entries.groupBy("bin").applyInArrow(_covered(length), COVER_SCHEMA))
    of_hot = found.where("kind = 'hot'").select("block", "spans", "data")
    if not of_hot.isEmpty():

        def of_windows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            of, _, hashes = _windows(row, length)
            return _smallest(hashes, np.frombuffer(row["spans"], np.int64).reshape(-1, 4)[of, 3])

        answers = firsts(of_hot, of_windows, net)
        covers = covers.unionByName(answers.groupBy("block").cogroup(of_hot.groupBy("block")).applyInArrow(_hot_covered(length), COVER_SCHEMA))
    return covers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_without, KEPT_SCHEMA)


def groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(repeat, length, doc_id, start): the maximal repeats within segments and all their occurrences.

    A repeat that spans several segments is one group in each. repeat is a hash of its bytes.
    Anchors are never hot here: all their entries meet.
    """

    def run(table: pa.Table) -> pa.Table:
        texts, of, order, repeats = _scan(table, length)
        segment = table.column("segment").to_pylist()
        rows = []
        for size, a, b in repeats:
            i, j = of[order[a]]
            name = int(np.uint64(xxhash.xxh64_intdigest(texts[i][j : j + size])).astype(np.int64))
            rows += [(name, size, segment[i], j) for i, j in (of[k] for k in order[a : b + 1])]
        return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("repeat", "length", "segment", "offset"))})

    _, found, _ = _entries(docs, length, gram, block_bytes, np.iinfo(np.int64).max, None, True)
    seen = found.where("kind = 'seen'").select("segment", F.col("doc").alias("doc_id"), "start", "whole")
    whole = seen.where("whole IS NOT NULL").select(F.col("segment").alias("repeat"), F.col("whole").alias("length"), "doc_id", "start")
    of_bins = found.where("kind = 'entry'").groupBy("bin").applyInArrow(run, GROUP_SCHEMA)
    parts = of_bins.join(seen.drop("whole"), "segment").select("repeat", "length", "doc_id", (F.col("start") + F.col("offset")).alias("start"))
    return whole.unionByName(parts)


def digests(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``remove`` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
