"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: a history h with c(h) occurrences
gives P(w | h) = (c(h w) + MU * P(w | h')) / (c(h) + MU), h' being h without its first
word; at the bottom P(w) = (c - D) / N for known words, and the discounts D, one for each
known word, go to unknown words as one class. So each history is a state; a seen n-gram is
an arc with its probability, and a failure arc with MU / (c(h) + MU) leads from h to h'.
One traversal from left to right carries the state and adds up the logarithms.

The automaton of a large corpus fits no single machine, so each block of documents gets
the part that its own n-grams touch: it asks for the counts of its distinct n-grams in
training texts (see ``_ranges``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._ranges import Network, blocks_of, counted, counts_of, mix64, texts_of
from recollect.llm._text import words

ORDER, MU = 3, 50.0
#: Rows whose crc32(doc_id as text) has this remainder are held out of the counts.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block.
BLOCK_BYTES = 5_000_000

_END = b""  # no word is empty


def held_out(doc_id: int | None, folds: int = FOLDS, fold: int = HELD_OUT) -> bool:
    """Whether the document is kept from training; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


@dataclass
class Block:
    """The tokens of some documents and their distinct n-grams.

    ``grams[k]`` has at each token the number of the (k+1)-gram that ends there, -1 where
    the text is too short; ``last[k]`` and ``before[k]`` are its last word and the number of
    the k-gram without it; ``hashes`` and ``counts`` (in training texts) are of all levels in turn.
    """

    ids: list
    ends: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)
    before: list[np.ndarray] = field(default_factory=list)
    last: list[np.ndarray] = field(default_factory=list)
    hashes: np.ndarray = None
    counts: np.ndarray = None

    @classmethod
    def of(cls, ids: list, texts: Iterator[bytes], order: int, bits: int = 64) -> Block:
        numbers: dict[bytes, int] = {}
        number, parts = numbers.setdefault, []
        for text in texts:
            own = words(text)
            own.append(_END)
            parts.append(np.fromiter([number(x, len(numbers)) for x in own], np.int64, len(own)))
        lengths = np.array([len(x) for x in parts], np.int64)
        block = cls(ids, np.cumsum(lengths))
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = np.arange(len(tokens)) - np.repeat(block.ends - lengths, lengths)
        train = np.repeat(np.array([not held_out(i) for i in ids], bool), lengths)
        n = len(numbers)
        word_hash = np.fromiter((xxhash.xxh64_intdigest(x) for x in numbers), np.uint64, n)
        block.grams, block.before, block.last = [tokens], [np.zeros(n, np.int64)], [np.arange(n)]
        hashes, counts = [word_hash], [np.bincount(tokens[train], minlength=n)]
        level = word_hash
        for k in range(1, order):
            at = np.flatnonzero(place >= k)
            pairs, inverse = np.unique(block.grams[-1][at - 1] * n + tokens[at], return_inverse=True)
            here = np.full(len(tokens), -1, np.int64)
            here[at] = inverse
            block.grams.append(here)
            block.before.append(pairs // n if n else pairs)
            block.last.append(pairs % n if n else pairs)
            level = mix64(level[block.before[k]] * np.uint64(0x9E3779B97F4A7C15) + word_hash[block.last[k]])
            hashes.append(level)
            counts.append(np.bincount(inverse[train[at]], minlength=len(pairs)))
        # the lowest bit tells words from longer n-grams
        cut = [(x >> np.uint64(64 - bits)) & ~np.uint64(1) for x in hashes]
        cut[0] |= np.uint64(1)
        block.hashes, block.counts = np.concatenate(cut), np.concatenate(counts).astype(np.int64)
        return block


class Automaton:
    """The backoff automaton of a block, from the corpus counts of its n-grams.

    ``arcs[k]`` has for each (k+1)-gram the log10 weight of the arc that reads its last
    word in the state of its first k words, NaN if the n-gram was never seen; the state
    reached is the n-gram itself (its own longest seen suffix at full order). ``fail[k]``
    has for each (k+1)-gram the weight of its state's failure arc.
    """

    def __init__(self, block: Block, counts: np.ndarray, tokens: int, types: int, ones: int, twos: int, mu: float):
        sizes = np.cumsum([0, *(len(x) for x in block.last)])
        levels = [counts[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        discount = ones / (ones + 2 * twos) if 0 < ones and 0 < twos else 0.5
        unknown = discount * types / tokens if tokens else 1.0
        known = (levels[0] - discount) / max(tokens, 1)
        p = np.where(levels[0] > 0, known, unknown)  # of the word in the state of the empty history
        self.arcs, self.fail = [np.log10(p)], []
        suffix = [np.zeros(len(levels[0]), np.int64)]
        for k in range(1, len(levels)):
            context = levels[k - 1][block.before[k]]
            # the n-gram without its first word, one level down
            if k == 1:
                lower = p[block.last[1]]
                suffix.append(block.last[1])
            else:
                # n-grams of a level are in order of the one before and the last word
                words_ = len(block.last[0])
                known = block.before[k - 1] * words_ + block.last[k - 1]
                suffix.append(np.searchsorted(known, suffix[k - 1][block.before[k]] * words_ + block.last[k]))
                lower = p[suffix[k]]
            p = (levels[k] + mu * lower) / (context + mu)
            self.arcs.append(np.where(levels[k] > 0, np.log10(p), np.nan))
            self.fail.append(np.log10(mu / (levels[k - 1] + mu)))
        self.seen = [x > 0 for x in levels[:-1]]

    def score(self, grams: list[np.ndarray]) -> float:
        """log10 probability of one text, given the numbers of the n-grams that end at each token.

        The state is the longest history that is one, at most order - 1 words; it is carried
        as its length, as its number is that of the n-gram ending at the token before.
        """
        # weights by place in the text; where it is too short for an n-gram none is looked up
        at_places = lambda x, g: x[g].tolist() if len(x) else [math.nan] * len(g)
        arcs, fail, seen = ([at_places(x, g) for x, g in zip(of, grams, strict=False)] for of in (self.arcs, self.fail, self.seen))
        total, length, most = 0.0, 0, len(seen)
        for at in range(len(grams[0])):
            weight = arcs[length][at]
            while weight != weight:  # NaN: no such arc
                length -= 1
                total += fail[length][at - 1]
                weight = arcs[length][at]
            total += weight
            if length < most:
                length += 1
            while length and not seen[length - 1][at]:
                length -= 1
        return total


SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(order: int, mu: float, bits: int):
    def run(answers: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block = Block.of(row["ids"], texts_of(row), order, bits)
        by = np.argsort(block.hashes)
        counts = np.empty(len(by), np.int64)
        counts[by], totals = counts_of(answers)
        model = Automaton(block, counts, *totals, mu)
        tokens, types = totals[:2]
        c = counts[: len(block.last[0])][block.grams[0]]
        starts = block.ends - np.diff(block.ends, prepend=0)
        base = np.add.reduceat(np.log10((c + 1) / (tokens + types + 1)), starts)
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        scores = [
            model.score([g[a:b] for g in block.grams]) for a, b in zip(starts.tolist(), block.ends.tolist(), strict=True)
        ]
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "held_out": pa.array([held_out(i) for i in block.ids], pa.bool_()),
                "n_tokens": pa.array(block.ends - starts),
                "n_known": pa.array(known),
                "train_tokens": pa.array([tokens] * len(block.ids), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return run


def score_documents(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES, fan: int | None = None) -> DataFrame:
    """Score every whole text by the model of the texts that are not held out; see SCORE_SCHEMA.

    Tokens are the words, A-Z lower-cased, then one end. base_score is the add-one unigram
    score, n_known the tokens that training texts have, score the model's log10 probability.
    Null texts count as empty (one token, the end); a null doc_id is in training; repeated
    rows count and are scored each. Other columns are not read. No documents: no rows;
    nothing to learn from: all tokens are unknown.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, net = blocks_of(docs, block_bytes, order)
    net = net if fan is None else Network.of(net.ranges, net.bits, fan)

    def distinct(row: dict) -> tuple[np.ndarray, np.ndarray]:
        block = Block.of(row["ids"], texts_of(row), order, net.bits)
        by = np.argsort(block.hashes)
        return block.hashes[by], block.counts[by]

    answers = counted(blocks, distinct, net)
    return answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_score(order, mu, net.bits), SCORE_SCHEMA)
