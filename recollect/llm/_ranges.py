"""Counts over a corpus for what blocks of documents have, by an exchange of packed questions.

Documents are packed to blocks. A block sends the distinct hashes that it has, with its own
counts, dealt to ranges of hashes; a range adds up the blocks' counts and answers in the
order asked. What travels is packed in a few rows per block, and what is frequent is one
entry per block, so no hash is a hot key.

Where there are more than FAN ranges, questions go through several levels, FAN rows for each
block at each level: a node of a level has the questions of some blocks about some range,
adds them up and asks on, about FAN parts of its range, together with other nodes; answers
come back the same way. So rows grow with the corpus times the logarithm of its size.

Hashes are as wide as the corpus needs: two of them agree by chance with a probability of
2^-SPARE_BITS at most for each, whatever the size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import distinct as distinct_values
from recollect.llm._text import string_column
from recollect.session import written

#: Rows that a block or a node sends at each level.
FAN = 256
SPARE_BITS, LEAST_BITS = 12, 44
#: Bytes of questions that leave Python at a time.
SENT_BYTES = 4_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(sorted_hashes: np.ndarray, first: int, parts: int, ranges: int, bits: int) -> np.ndarray:
    """Where each of ``parts`` ranges from ``first`` on starts and ends, of all ``ranges`` of the hashes."""
    edges = [((first + i) << bits) // ranges for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), [len(sorted_hashes)]])


def _pack_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Differences of a sorted run, transposed by byte so that their leading zeros compress."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each; larger counts apart."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, np.int64)
    return out


BLOCK_SCHEMA = "block long, ids array<long>, ends binary, data binary"
#: Questions: from a block or node to a node, about the range that has this place among those asked.
ASK_SCHEMA = "node string, asker string, part int, hashes binary, low binary, high binary"
ANSWER_SCHEMA = "asker string, part int, low binary, high binary, tokens long, types long, ones long, twos long"
_TOTALS = ("tokens", "types", "ones", "twos")


def texts_of(row: dict) -> list[bytes]:
    """The texts of a block."""
    ends, data = np.frombuffer(row["ends"], np.int64).tolist(), zstandard.ZstdDecompressor().decompress(row["data"])
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(block_bytes: int):
    """Packs the texts of a task to blocks; numbered by task, which holds once they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in texts]).astype(np.int64).tobytes()
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            columns = [pa.array([nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "ends", "data"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), string_column(batch, "text"), strict=True):
                ids.append(doc)
                texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1]) + 1
                if size >= block_bytes:
                    yield made()
                    nth, ids, texts, size = nth + 1, [], [], 0
        if ids:
            yield made()

    return run


@dataclass(frozen=True)
class Network:
    """``levels`` levels of ranges, ``fan`` times as many at each; nodes are named by level, group and range."""

    levels: int
    fan: int
    bits: int
    ranges: int

    @classmethod
    def of(cls, ranges: int, bits: int, fan: int = FAN) -> Network:
        levels = 1
        while fan**levels < ranges:
            levels += 1
        each = next(n for n in range(1, fan + 1) if n**levels >= ranges)
        return cls(levels, each, bits, ranges)

    def asked(self, asker: str, level: int, group: int, place: int, hashes: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Questions about sorted hashes to the nodes of the next level; ``place`` is the asker's range."""
        cuts = _cuts(hashes, place * self.fan, self.fan, self.fan ** (level + 1), self.bits)
        upper = group // self.fan if level else group
        rows = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            rows.append((f"{level + 1}.{upper}.{place * self.fan + i}", asker, i, _pack_hashes(hashes[a:b]), *_pack_counts(counts[a:b])))
        return rows


_ASK_TYPES = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER_TYPES = [pa.string(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _batches(rows: list[tuple], schema: str, kinds: list) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about SENT_BYTES; they are taken from the list."""
    rows.reverse()
    while rows:
        some, size = [], 0
        while rows and size < SENT_BYTES:
            some.append(rows.pop())
            size += sum(len(x) for x in some[-1] if isinstance(x, bytes))
        yield _batch(some, schema, kinds)


def _ask(distinct: Callable[[dict], tuple[np.ndarray, np.ndarray]], net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                # which blocks meet first is decided by hash, so groups have about the same number
                group = xxhash.xxh64_intdigest(str(row["block"])) % net.fan ** (net.levels - 1)
                yield from _batches(net.asked(str(row["block"]), 0, group, 0, *distinct(row)), ASK_SCHEMA, _ASK_TYPES)

    return run


def _questions(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct hashes, their counts, for each question the places of what it asked)."""
    asked = [_unpack_hashes(x.as_py()) for x in table.column("hashes")]
    hashes = distinct_values(np.concatenate(asked))
    places = [np.searchsorted(hashes, x).astype(np.int32) for x in asked]
    sums = np.zeros(len(hashes), np.int64)
    for place, low, high in zip(places, table.column("low"), table.column("high"), strict=True):
        np.add.at(sums, place, _unpack_counts(low.as_py(), high.as_py()))  # two n-grams of a block may have one hash
    return hashes, sums, places


def _merge(net: Network):
    """A node's questions, added up, to the next level."""

    def run(table: pa.Table) -> pa.Table:
        name = table.column("node")[0].as_py()
        level, group, place = map(int, name.split("."))
        hashes, sums, _ = _questions(table)
        return pa.Table.from_batches(_batches(net.asked(name, level, group, place, hashes, sums), ASK_SCHEMA, _ASK_TYPES))

    return run


def _replies(table: pa.Table, sums: np.ndarray, places: list[np.ndarray], totals: list[int]) -> pa.Table:
    rows = [
        (asker, part, *_pack_counts(sums[x]), *totals)
        for asker, part, x in zip(table.column("asker").to_pylist(), table.column("part").to_pylist(), places, strict=True)
    ]
    return pa.Table.from_batches([_batch(rows, ANSWER_SCHEMA, _ANSWER_TYPES)])


def _answer(table: pa.Table) -> pa.Table:
    """The last level knows the counts."""
    hashes, sums, places = _questions(table)
    of_words = sums[(hashes & np.uint64(1)).astype(bool)]
    return _replies(table, sums, places, [int(x) for x in (of_words.sum(), (of_words > 0).sum(), (of_words == 1).sum(), (of_words == 2).sum())])


def counts_of(answers: pa.Table) -> tuple[np.ndarray, list[int]]:
    answers = answers.sort_by("part")
    counts = [_unpack_counts(a.as_py(), b.as_py()) for a, b in zip(answers.column("low"), answers.column("high"), strict=True)]
    return np.concatenate(counts), [sum(answers.column(k).to_pylist()) for k in _TOTALS]


def _hand_down(answers: pa.Table, table: pa.Table) -> pa.Table:
    """A node's answers, to those that asked it."""
    _, _, places = _questions(table)
    counts, totals = counts_of(answers)
    return _replies(table, counts, places, totals)


def blocks_of(docs: DataFrame, block_bytes: int, each: int) -> tuple[DataFrame, Network]:
    """(blocks as in BLOCK_SCHEMA of docs (doc_id long, text), the network for ``each`` hashes a byte)."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = min(64, max(LEAST_BITS, (size * each).bit_length() + SPARE_BITS))
    # written, so that all passes and tasks that are run again see the same blocks
    blocks = written(docs.mapInArrow(_blocks(block_bytes), BLOCK_SCHEMA), "blocks")
    return blocks, Network.of(max(1, -(-size // block_bytes)), bits)


def counted(blocks: DataFrame, distinct: Callable[[dict], tuple[np.ndarray, np.ndarray]], net: Network) -> DataFrame:
    """ANSWER_SCHEMA with ``block``: what the corpus has of the (hashes ascending, counts) that ``distinct`` gives of each block.

    ``counts_of`` puts a block's answers together, in the order of its hashes.
    """
    asked = [blocks.mapInArrow(_ask(distinct, net), ASK_SCHEMA)]
    while len(asked) < net.levels:
        asked[-1] = written(asked[-1], "questions", wide=True)
        asked.append(asked[-1].groupBy("node").applyInArrow(_merge(net), ASK_SCHEMA))
    answers = asked[-1].groupBy("node").applyInArrow(_answer, ANSWER_SCHEMA)
    for questions in reversed(asked[:-1]):
        answers = answers.groupBy("asker").cogroup(questions.groupBy("node")).applyInArrow(_hand_down, ANSWER_SCHEMA)
    return answers.select(F.col("asker").cast("long").alias("block"), "*")
