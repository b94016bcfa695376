"""Shingles are made slice by slice, with the same result."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard

from recollect.llm import decontam, similar
from tests.llm.test_memory import peak


def test_memory_of_shingles():
    """A block is cut to shingles slice by slice, with the same result."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)).encode() for n in [0, 3, 5, *[400] * 2000]]
    data = b"".join(texts)
    row = {"ends": np.cumsum([len(x) for x in texts]).astype(np.int64).tobytes(), "data": zstandard.ZstdCompressor().compress(data)}
    assert peak(lambda: similar.shingles(texts)) < 8 * len(data)
    whole, parts = similar.shingles(texts, at_once=len(data)), similar.shingles(texts, at_once=5_000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(similar._distinct(similar.SHINGLE, 64)(row)[0]) == len(np.unique(whole[1]))
    assert len(similar.shingles([])[0]) == 0


def test_texts_are_cut_to_tokens_few_at_a_time(monkeypatch):
    """Documents of a batch are looked through some at a time; what is found is the same."""
    seen, tokens = [], decontam.Canonical.tokens
    monkeypatch.setattr(decontam.Canonical, "tokens", lambda self, texts: (seen.append(sum(map(len, texts))), tokens(self, texts))[1])
    texts = [" ".join(f"w{(i + j) % 97}" for j in range(20_000)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "th": [0] * 40, "text": texts})
    every = SimpleNamespace(value=np.full(1 << 17, 255, np.uint8))
    found = lambda: pa.Table.from_batches(decontam._document_windows(every, 20, [(decontam.WORDS, 8)])([batch])).sort_by([("doc_id", "ascending"), ("doc_at", "ascending"), ("hash", "ascending")])
    few = found()
    assert sum(seen) == sum(map(len, texts)) and max(seen) < 1_200_000
    monkeypatch.setattr(decontam, "_CHUNK_BYTES", sum(map(len, texts)))
    assert few.equals(found())
