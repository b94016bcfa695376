"""Shards of phrases: counts leave as they are made, words are spelt by number, large rows are written in small pieces."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollect import session
from recollect.llm import _ranges, phrases
from tests.llm.test_corpus import phrases_by_hand, sentences


@pytest.fixture
def task(monkeypatch):
    monkeypatch.setattr(phrases.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())


def shard(text: str) -> dict:
    (batch,) = phrases._shards(iter([pa.RecordBatch.from_pylist([{"lang": "en", "text": text}])]))
    return batch.to_pylist()[0]


def by_hand(text: str) -> Counter:
    pieces = phrases.pieces_of(text.encode())
    return Counter(b" ".join(p[i : i + k]).decode() for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))


def answered(row: dict, bits: int) -> list[pa.RecordBatch]:
    """A shard and the answers about its own cells, of two nodes, the later one first."""
    cells, counts = phrases.Grams(row, 3).cells(bits)
    parts = [(part, *_ranges._pack_counts(x)) for part, x in enumerate(np.split(counts, [len(cells) // 3]))]
    schema = pa.schema([("part", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("lang", pa.string()), ("data", pa.binary())])
    made = [{"part": part, "low": low, "high": high} for part, low, high in reversed(parts)]
    return [pa.RecordBatch.from_pylist([x], schema) for x in (made[0], {"lang": row["lang"], "data": row["data"]}, made[1])]


@pytest.mark.parametrize(("letters", "at_once"), [(64, 100), (2, 100), (3, 7)])
def test_counts_leave_a_shard_as_they_are_made(task, monkeypatch, letters, at_once):
    """All at once, those of a shard took as much memory as the rest of its task; the more text a corpus has, the more they are."""
    rng = random.Random(2)
    text = "\n".join(sentences(rng, 40) + f" {rng.choice('ab')} {rng.choice('ab')}b ba, b ab" for _ in range(60))
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "LETTERS_AT_ONCE", 90)
    monkeypatch.setattr(phrases, "LETTERS", letters)
    got = list(phrases._counted(40, 3, 2)(iter(answered(shard(text), 40))))
    assert len(got) > 3 and max(x.num_rows for x in got) <= at_once
    found = Counter({k.removeprefix("en\t"): f for x in got for k, f in zip(x["key"].to_pylist(), x["f"].to_pylist(), strict=True)})
    assert found == Counter({k: f for k, f in by_hand(text).items() if f >= 2})


def test_two_levels_of_ranges(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(rng.choice(["en", "de"]), sentences(rng, 30)) for _ in range(60)]
    monkeypatch.setattr(phrases, "RANGE_BYTES", 20)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    assert _ranges.Network.of(sum(len(t) for _, t in docs) // 20, 16).levels == 2
    assert sorted(map(tuple, phrases.mine(df).collect())) == phrases_by_hand(docs)


def test_questions_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(_ranges, "SENT_BYTES", 2_000)
    hashes = np.unique(np.random.default_rng(4).integers(0, 1 << 48, 4_000, dtype=np.uint64))
    rows = _ranges.Network.of(100, 48).asked("7", 0, 0, 0, hashes, np.ones(len(hashes), np.int64))
    want = [x[3] for x in rows]
    got = list(_ranges._batches(rows, _ranges.ASK_SCHEMA, _ranges._ASK_TYPES))
    assert len(got) > 10 and [x for b in got for x in b["hashes"].to_pylist()] == want


def test_a_hash_that_a_question_has_twice_counts_twice():
    hashes, counts = np.array([3, 5, 5, 9], np.uint64), np.array([1, 2, 300, 4])
    net = _ranges.Network.of(1, 44)
    table = pa.Table.from_batches([_ranges._batch(net.asked(x, 0, 0, 0, hashes, counts), _ranges.ASK_SCHEMA, _ranges._ASK_TYPES) for x in "78"])
    answers = _ranges._answer(table)
    assert [_ranges.counts_of(answers.slice(i, 1))[0].tolist() for i in (0, 1)] == [[2, 604, 604, 8]] * 2


def test_large_rows_are_written_in_small_pieces(spark):
    """A page was looked at after 100 rows, so one of questions had up to 100 MB, and a row group 128 MB."""
    df = spark.range(200, numPartitions=1).select("id", F.expr("cast(array_join(transform(sequence(1, 30000), x -> hex(hash(id, x))), '') as binary)").alias("data"))
    for wide in (False, True):
        out = session.written(df, "wide-rows", wide=wide)
        files = [pq.ParquetFile(p) for p in Path(out.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet")]
        sizes = [f.metadata.row_group(i).column(1).total_compressed_size for f in files for i in range(f.num_row_groups)]
        assert out.count() == 200 and (max(sizes) < 2**24 * 1.2) == wide


def test_phrases_of_many_different_words(task):
    """Numbers of three of them don't fit a double's 53 bits."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(250_000)]
    rng.shuffle(words)
    grams = phrases.Grams(shard(" ".join(words)), 3)
    found = {tuple(x) for some in grams.candidates(40, grams.cells(40)[0]) if some.shape[1] == 3 for x in some.tolist()}
    place = {name.decode(): i for i, name in enumerate(grams.names)}
    assert found == {tuple(place[w] for w in words[i : i + 3]) for i in range(len(words) - 2)}
