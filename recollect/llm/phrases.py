"""Phrase collocations: candidates by a count sketch, exact counts by automata, scores by the weakest cut.

Texts are packed to shards of one language. A first pass adds up a one-row count sketch of
all phrases of up to ``MOST`` words: each shard sends its cells to the ranges of cells that
own them and gets the sums back (see ``_ranges``). The sketch is as wide as the corpus needs
and is never whole in one place; a cell's sum is an upper bound of each phrase in it. Phrases of a
shard whose bound reaches ``LEAST`` are its candidates; they are compiled to Aho-Corasick
automata, words by number between delimiters, which count their overlapping matches in that shard.
Only the sums of those decide, so the sketch can't drop or add anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._ranges import Network, _unpack_counts, counted, mix64
from recollect.llm._text import distinct, gives_back, string_column
from recollect.session import small_batches, written

MOST, LEAST, TOP = 3, 10, 2000
#: A candidate goes where some longer one has this share of its occurrences, in percent.
ABSORBED = 50
#: Bytes of text in a shard, and those that a task holds back for shards of all languages.
SHARD_BYTES, HELD_BYTES = 12_000_000, 48_000_000
#: Bytes of text for each range of cells.
RANGE_BYTES = 4_000_000
#: Cells of the sketch for each byte of text, which are about as many as there are distinct phrases.
CELLS = 0.15
#: Phrases of an automaton, and letters that it reads at a time.
AT_ONCE, LETTERS_AT_ONCE = 150_000, 1_000_000
#: Places of a shard that are looked through at a time.
PLACES_AT_ONCE = 1_000_000
#: Letters that a word's number is spelt with.
LETTERS = 64

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Piece ends become line feeds, tabs spaces.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + _UPPER, b"\n" * 9 + b" " + _LOWER)

#: Looks for what repeats in the whole shard, as copies do.
_TIGHT = zstandard.ZstdCompressionParameters.from_level(12, window_log=24, enable_ldm=True)

SHARD_SCHEMA = "block long, lang string, n_words long, data binary"
COUNT_SCHEMA = "lang string, words int, phrase string, f long"


def pieces_of(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text, pieces without words left out."""
    return [w for piece in text.translate(_PIECES).split(b"\n") if (w := [x for x in piece.split(b" ") if x])]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the texts of a task by language: pieces as lines, words between single spaces."""
    nth = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    numbers: dict[str, int] = {}

    def made(lang: str) -> pa.RecordBatch:
        nonlocal nth
        nth += 1
        sizes.pop(lang)
        data = zstandard.ZstdCompressor(compression_params=_TIGHT).compress(b"\n".join(held.pop(lang)))
        columns = [pa.array([nth], pa.int64()), pa.array([lang]), pa.array([numbers.pop(lang)], pa.int64()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "lang", "n_words", "data"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), string_column(batch, "text"), strict=True):
            pieces = pieces_of(text.as_buffer().to_pybytes())
            if not pieces:
                continue
            lines = b"\n".join(b" " + b" ".join(p) + b" " for p in pieces)
            held.setdefault(lang, []).append(lines)
            sizes[lang] = sizes.get(lang, 0) + len(lines)
            numbers[lang] = numbers.get(lang, 0) + sum(map(len, pieces))
            if sizes[lang] >= SHARD_BYTES:
                yield made(lang)
            elif sum(sizes.values()) >= HELD_BYTES:
                yield made(max(sizes, key=sizes.get))
    for lang in list(held):
        yield made(lang)


def _joined(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word after them."""
    return mix64(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


class Grams:
    """The words of a shard and its phrases; one length of them is in memory at a time."""

    def __init__(self, row: dict, most: int):
        self.most = most
        text = zstandard.ZstdDecompressor().decompress(row["data"])
        # each token, a word or the line feed between two pieces, has one space after it
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20).astype(np.int32) + 1
        tokens = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        names = [x[:-1] for x in tokens.dictionary.to_pylist()]
        line = names.index(b"\n") if b"\n" in names else len(names)
        self.names = [b"\n", *names[:line], *names[line + 1 :]]
        tokens = tokens.indices.to_numpy()
        self.tokens = np.where(tokens == line, np.int32(0), tokens + (tokens < line))
        seed = xxhash.xxh64_intdigest(row["lang"].encode())
        self.digits = next(d for d in count(1) if LETTERS**d >= len(self.names))
        self.dictionary = pa.array(self.names, pa.binary())
        self.of_name = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in self.names), np.uint64, len(self.names))

    def _words(self, k: int) -> list[np.ndarray]:
        """The first words of all phrases of k words, their second, .. to their last."""
        n = max(len(self.tokens) - k + 1, 0)
        inside = np.logical_and.reduce([self.tokens[i : i + n] > 0 for i in range(k)])
        return [self.tokens[i : i + n][inside] for i in range(k)]

    def _hashes(self, words: list[np.ndarray]) -> np.ndarray:
        of = self.of_name[words[0]]
        for word in words[1:]:
            of = _joined(of, self.of_name[word])
        return of

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells that phrases of the shard fall into, ascending, how many of its phrases do)."""
        every, n = np.empty(self.most * len(self.tokens), np.uint64), 0
        for k in range(1, self.most + 1):
            hashes = self._hashes(self._words(k))
            np.right_shift(hashes, np.uint64(64 - bits), out=every[n : n + len(hashes)])
            n += len(hashes)
            del hashes
        every = every[:n]
        every.sort()  # in place, as this is the largest array of a shard
        new = np.ones(n, bool)
        np.not_equal(every[1:], every[:-1], out=new[1:])
        places = [np.flatnonzero(new[i : i + PLACES_AT_ONCE]).astype(np.int32) + np.int32(i) for i in range(0, n, PLACES_AT_ONCE)]
        first = np.concatenate(places or [np.zeros(0, np.int32)])
        return every[first], np.diff(first, append=np.int32(n))

    def candidates(self, bits: int, cells: np.ndarray) -> Iterator[np.ndarray]:
        """The distinct phrases in some cells, ascending: a row of word numbers each, by length, then words, AT_ONCE at most in an array."""
        if not len(cells):
            return
        size = np.uint64(len(self.names))
        for k in range(1, self.most + 1):
            # distinct by their words, not by a hash; a shard has too few words for a number to overflow
            key = np.zeros(1, np.uint64)
            for word in self._words(k):
                key = key * size + word.astype(np.uint64)  # with a signed one it would be a double
            key = distinct(key)
            for first in range(0, len(key), AT_ONCE):
                some, words = key[first : first + AT_ONCE], []
                for _ in range(k):
                    rest = some // size
                    words.append((some - rest * size).astype(np.int32))
                    some = rest
                words.reverse()
                of = self._hashes(words) >> np.uint64(64 - bits)
                by = np.argsort(of)  # so that the cells are gone through in order
                of = of[by]
                likely = np.sort(by[cells[np.minimum(np.searchsorted(cells, of), len(cells) - 1)] == of])
                if len(likely):
                    yield np.stack([word[likely] for word in words], axis=1)

    def _letters(self, words: np.ndarray) -> str:
        """Words as ``digits`` letters each; the first is one that only begins words, so it guards them as a delimiter does."""
        out, rest = np.empty((words.size, self.digits), np.uint8), words.ravel()
        for i in reversed(range(self.digits)):
            out[:, i] = rest % LETTERS
            rest = rest // LETTERS
        out[:, 0] += LETTERS
        return out.tobytes().decode("ascii")

    def _parts(self) -> Iterator[str]:
        """The shard in parts of whole pieces, as letters."""
        ends, first = np.append(np.flatnonzero(self.tokens == 0), len(self.tokens)), 0
        while first < len(self.tokens):
            end = ends[max(np.searchsorted(ends, first + LETTERS_AT_ONCE // self.digits, "right") - 1, 0)]
            end = end if end > first else ends[np.searchsorted(ends, first, "right")]
            yield self._letters(self.tokens[first:end])
            first = end

    def phrases(self, words: np.ndarray) -> pa.Array:
        """Phrases, rows of word numbers, as words between single spaces."""
        return pc.binary_join_element_wise(*(self.dictionary.take(pa.array(word)) for word in words.T), b" ")

    def occurrences(self, words: np.ndarray) -> np.ndarray:
        """How often each of some phrases, rows of word numbers, occurs."""
        if words.shape[1] == 1:
            return np.bincount(self.tokens, minlength=len(self.names))[words[:, 0]]
        automaton, letters, size = ahocorasick.Automaton(), self._letters(words), words.shape[1] * self.digits
        for i in range(len(words)):
            automaton.add_word(letters[i * size : (i + 1) * size], i)
        automaton.make_automaton()
        out = np.zeros(len(words), np.int64)
        for part in self._parts():
            out += np.bincount(np.fromiter((i for _, i in automaton.iter(part)), np.int32), minlength=len(out))
        return out


def _cells(bits: int, most: int):
    """The sketch of a shard."""

    def run(row: dict) -> tuple[np.ndarray, np.ndarray]:
        gives_back()
        return Grams(row, most).cells(bits)

    return run


def _counted(bits: int, most: int, least: int):
    """Counts of the candidates of a shard in that shard, for a shard and the answers that it got; an automaton's phrases leave at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gives_back()
        row, reach = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                if one["data"] is None:
                    reach[one["part"]] = _unpack_counts(one["low"], one["high"]) >= least
                else:
                    row = one
        grams, lang = Grams(row, most), pa.scalar(row["lang"].encode() + b"\t")
        del batch, one, row
        cells = grams.cells(bits)[0][np.concatenate([reach.pop(part) for part in sorted(reach)])]
        for words in grams.candidates(bits, cells):
            counts = pa.array(grams.occurrences(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, grams.phrases(words), b"").cast(pa.string()), counts], ["key", "f"])

    return run


def counts(docs: DataFrame, most: int = MOST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of 1 to ``most`` words with f >= least, (lang, n)), written.

    Null languages are ``und``; null texts are empty.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    small_batches(docs.sparkSession)
    shards = written(docs.mapInArrow(_shards, SHARD_SCHEMA), "phrase-shards", wide=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(60, max(16, int(size * CELLS).bit_length()))
    net = Network.of(max(1, -(-size // RANGE_BYTES)), bits)
    answers = counted(shards.select("block", "lang", "data"), _cells(bits, most), net)
    both = answers.select("block", "part", "low", "high").unionByName(shards.select("block", "lang", "data"), allowMissingColumns=True)
    own = both.groupBy("block").applyInArrow(_counted(bits, most, least), "key string, f long")
    # a language and a phrase travel as one string; there is no tab in a phrase
    sums = own.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrase = F.substring_index("key", "\t", -1)
    sums = sums.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), F.size(F.split(phrase, " ")).alias("words"), phrase.alias("phrase"), "f")
    return written(sums, "phrase-counts"), shards.groupBy("lang").agg(F.sum("n_words").alias("n"))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 3 words.

    a is how often the phrase occurs, at least ``least``; cut after its first words it falls into two
    parts with l and r occurrences, and the cut with the lowest floor(10^6 a a / (l r)) is its
    score, the earlier of equals. A phrase goes if a longer candidate around it has ``absorbed`` percent of
    its occurrences. Products are decimals of 38 digits. Equal scores go by a, then by phrase in
    bytes. Null texts are empty, null languages ``und``; repeated rows count each; no phrases, no rows.
    """
    return ranked(*counts(docs, MOST, least), top, absorbed)


def ranked(sums: DataFrame, sizes: DataFrame, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The scoring part of ``mine``: from what ``counts`` gives to the best of each language."""
    candidates = sums.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("tail"),
    )
    part = lambda column, f: sums.select("lang", F.col("phrase").alias(column), F.col("f").alias(f))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    exact = lambda x: f"CAST({x} AS DECIMAL(15,0))"
    cut = cut.withColumn("score", F.expr(f"(1000000 * {exact('a')} * {exact('a')}) DIV ({exact('l')} * {exact('r')})"))
    scored = cut.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    longer = candidates.where("words = 3").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase"), "a")
    longest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("in_longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("in_longer") < absorbed * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("m.score").desc(), F.col("a").desc(), F.col("phrase")))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
