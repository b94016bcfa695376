"""What a task keeps in memory at a time, and that it doesn't matter for the result."""

import random
import tracemalloc

import pyarrow as pa

from recollect.llm import phrases
from tests.llm.test_corpus import phrases_by_hand, sentences


def peak(made) -> int:
    tracemalloc.start()
    try:
        made()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def shard(words: int) -> dict:
    rng = random.Random(11)
    text = " ".join(f"w{int(rng.random() ** 3 * 5000)}" for _ in range(words))
    (batch,) = phrases._shards(iter([pa.RecordBatch.from_pylist([{"lang": "en", "text": text}])]))
    return batch.to_pylist()[0]


def test_memory_of_a_shard(monkeypatch):
    """One length of phrases at a time: all of them with their hashes and places took over 120 bytes a word."""
    monkeypatch.setattr(phrases.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    row = shard(200_000)
    assert peak(lambda: phrases.Grams(row, 3).cells(26)) < 90 * 200_000


def test_phrases_in_several_automata(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(rng.choice(["en", None]), sentences(rng, 80) + " é ß Ü é ß") for _ in range(40)]
    monkeypatch.setattr(phrases, "AT_ONCE", 7)
    monkeypatch.setattr(phrases, "LETTERS_AT_ONCE", 50)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrases.mine(df).collect())) == phrases_by_hand(docs)
