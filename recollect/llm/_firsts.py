"""Counts over a corpus, as ``_ranges`` makes them, that also say who has something first.

Questions carry, for each hash, the smallest document of the asker that has it and the
block it is in; of all that ask about a hash, the one with the smallest is told so. Exactly
one block is told for each hash, over all levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _ranges as R
from recollect.session import written

ASK_SCHEMA = R.ASK_SCHEMA + ", docs binary, owners binary"
ANSWER_SCHEMA = "asker string, part int, low binary, high binary, first binary"
_ASK_TYPES = [*R._ASK_TYPES, pa.binary(), pa.binary()]
_ANSWER_TYPES = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _pack(x: np.ndarray) -> bytes:
    """Transposed by byte: what ids have in common compresses."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _asked(net: R.Network, asker: str, level: int, group: int, place: int, hashes: np.ndarray, counts: np.ndarray, docs: np.ndarray, owners: np.ndarray) -> list[tuple]:
    cuts = R._cuts(hashes, place * net.fan, net.fan, net.fan ** (level + 1), net.bits)
    rows = net.asked(asker, level, group, place, hashes, counts)
    return [(*row, _pack(docs[a:b]), _pack(owners[a:b])) for row, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)]


def _ask(distinct: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], net: R.Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                name = str(row["block"])
                group = xxhash.xxh64_intdigest(name) % net.fan ** (net.levels - 1)
                hashes, counts, docs = distinct(row)
                yield R._batch(_asked(net, name, 0, group, 0, hashes, counts, docs, np.full(len(docs), row["block"])), ASK_SCHEMA, _ASK_TYPES)

    return run


def _questions(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes, sums, smallest documents, their blocks; for each question the places of what it asked and whether it has the smallest)."""
    hashes, sums, places = R._questions(table)
    docs = np.concatenate([_unpack(x.as_py()) for x in table.column("docs")])
    owners = np.concatenate([_unpack(x.as_py()) for x in table.column("owners")])
    of = np.concatenate(places)
    by = np.lexsort((owners, docs, of))
    heads = by[np.searchsorted(of[by], np.arange(len(hashes)))]
    first = np.zeros(len(of), bool)
    first[heads] = True
    return hashes, sums, docs[heads], owners[heads], places, np.split(first, np.cumsum([len(x) for x in places])[:-1])


def _merge(net: R.Network):
    def run(table: pa.Table) -> pa.Table:
        name = table.column("node")[0].as_py()
        level, group, place = map(int, name.split("."))
        hashes, sums, docs, owners, _, _ = _questions(table)
        return pa.Table.from_batches([R._batch(_asked(net, name, level, group, place, hashes, sums, docs, owners), ASK_SCHEMA, _ASK_TYPES)])

    return run


def _replies(table: pa.Table, sums: np.ndarray, own: np.ndarray, places: list[np.ndarray], first: list[np.ndarray]) -> pa.Table:
    rows = [
        (asker, part, *R._pack_counts(sums[x]), np.packbits(f & own[x]).tobytes())
        for asker, part, x, f in zip(table.column("asker").to_pylist(), table.column("part").to_pylist(), places, first, strict=True)
    ]
    return pa.Table.from_batches([R._batch(rows, ANSWER_SCHEMA, _ANSWER_TYPES)])


def _answer(table: pa.Table) -> pa.Table:
    _, sums, _, _, places, first = _questions(table)
    return _replies(table, sums, np.ones(len(sums), bool), places, first)


def answers_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(counts over the corpus, whether this asker is the first) of a block's or node's hashes, in their order."""
    answers = answers.sort_by("part")
    counts = [R._unpack_counts(a.as_py(), b.as_py()) for a, b in zip(answers.column("low"), answers.column("high"), strict=True)]
    first = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(c)).astype(bool) for x, c in zip(answers.column("first"), counts, strict=True)]
    return np.concatenate(counts), np.concatenate(first)


def _hand_down(answers: pa.Table, table: pa.Table) -> pa.Table:
    sums, own = answers_of(answers)
    _, _, _, _, places, first = _questions(table)
    return _replies(table, sums, own, places, first)


def firsts(blocks: DataFrame, distinct: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], net: R.Network) -> DataFrame:
    """ANSWER_SCHEMA with ``block``, for the (hashes ascending, counts, smallest documents) that ``distinct`` gives of each block."""
    asked = [blocks.mapInArrow(_ask(distinct, net), ASK_SCHEMA)]
    while len(asked) < net.levels:
        asked[-1] = written(asked[-1], "questions", wide=True)
        asked.append(asked[-1].groupBy("node").applyInArrow(_merge(net), ASK_SCHEMA))
    answers = asked[-1].groupBy("node").applyInArrow(_answer, ANSWER_SCHEMA)
    for questions in reversed(asked[:-1]):
        answers = answers.groupBy("asker").cogroup(questions.groupBy("node")).applyInArrow(_hand_down, ANSWER_SCHEMA)
    return answers.select(F.col("asker").cast("long").alias("block"), "*")
