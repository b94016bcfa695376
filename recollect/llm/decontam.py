"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was only given
other values keeps its template. Windows of template tokens are joined by hash with those
of the benchmark. A match names a document, an item and a diagonal; there the two are
aligned token by token: literals have to be equal, placeholders of one type may differ,
but one value of the item always stands for the same value in the document. A run of
consistent tokens that is long enough, and has enough literals or the item's own values,
is contamination.

That is done on two levels. Words are compared one by one. Slots are words too, but neighbouring
names are one, with words like "de" between them, so are neighbouring numbers, and a number with its unit: "New York" may
become "Paris", "twenty one" 35, "60cm" "80 cm". On slots a word in capitals is a name and an operator
behind a number is a word. Verbatim passages need only the words.

A capitalised word is a name wherever it stands, also where a sentence begins: whether it
is one can't be told there, and document and item are treated alike. Windows are joined by
their lower-cased words too, so a verbatim passage is found whatever is taken for a name.

Texts are read once for windows, which a bit map of the benchmark's hashes thins out, and
once more for the documents with matches, of which only the aligned stretches travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._text import fresh, string_column
from recollect.session import written

#: Tokens of a window; tokens in a row that are contamination (all of a shorter item).
WINDOW, LEAST_RUN = 8, 13
#: Literals that a window of WINDOW tokens needs to be joined by its template; literals of a run
#: with other values than the item's, and their least share of it. They define a template match.
WINDOW_LITERALS, RUN_LITERALS, LITERAL_SHARE = 2, 4, 1 / 3
#: Items that share a window from which on it is joined only where an item has no rarer ones.
SHARED = 32
#: Bits of the map for each window, as a power of two; least and most bits (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 7, 20, 27
#: Most benchmark windows, or tokens of items, that are broadcast; beyond, the joins shuffle.
BROADCAST_WINDOWS = 200_000
#: Bytes of text that are cut to tokens at a time; words that are remembered.
_CHUNK_BYTES, _CACHE_WORDS = 1_000_000, 300_000

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = re.compile(rb"\d+(?:[.,:/-]\d+)*(?:st|nd|rd|th)?")
_MEASURE = re.compile(rb"\d+(?:[.,]\d+)*([A-Za-z]+)")
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    b"eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    b"km cm mm kg mg ml lb lbs oz mph kmh hz khz mhz ghz kb mb gb tb usd eur second seconds minute minutes hour hours day days "
    b"week weeks month months year years mile miles foot feet inch inches yard yards meter meters metre metres kilometer "
    b"kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon "
    b"gallons dollar dollars cent cents euro euros percent degree degrees watt watts volt volts joule joules newton newtons".split()
)
#: Units only where a number stands right before them.
SHORT_UNITS = frozenset(b"m s h g l k c f w v j n am pm min sec hr hrs yr yrs ft in".split())
#: Short units that may stand apart from their number.
APART = SHORT_UNITS - {b"in"}
OPERATORS = frozenset(b"+ - * / = < > ^ %".split())
#: Words that belong to the names around them, at most two in a row.
PARTICLES = frozenset(b"de del della di da do dos du la le el al bin ibn van von der den y".split())
#: The last five are on slots what they and the words around them make of them ("forty-two" a number); as words all but
#: OPERATOR are literals.
SKIP, LITERAL, NUMBER, UNIT, MEASURE, NAME, CAPITALS, HYPHENATED, SHORT, PARTICLE, OPERATOR = range(11)
WORDS, SLOTS = range(2)
_SLOT_HASH = np.array([0, 0, *(xxhash.xxh64_intdigest(f"<{x}>") for x in ("number", "unit", "measure", "name"))], np.uint64)
_BASE, _SLOT_LEVEL = 0x9E3779B97F4A7C15, np.uint64(0x2545F4914F6CDD1D)


def _token(word: bytes) -> tuple[int, int]:
    """(kind, hash of the bare word in lower case)."""
    bare = word.strip(_PUNCTUATION)
    if not bare:
        return (OPERATOR if word in OPERATORS else SKIP), xxhash.xxh64_intdigest(word)
    text = bare.decode(errors="replace")
    low = text.lower().encode()
    kind = LITERAL
    if bare[:1].isdigit():
        measure = _MEASURE.fullmatch(low)
        if _NUMBER.fullmatch(low):
            kind = NUMBER
        elif measure and measure[1] in UNITS | SHORT_UNITS:
            kind = MEASURE
    elif low in NUMBER_WORDS:
        kind = NUMBER
    elif b"-" in low and NUMBER_WORDS.issuperset(low.split(b"-")):
        kind = HYPHENATED
    elif low in UNITS:
        kind = UNIT
    elif low in APART:
        kind = SHORT
    elif bare in PARTICLES:
        kind = PARTICLE
    elif len(text) > 1 and text[0].isupper():
        kind = CAPITALS if text.isupper() else NAME
    return kind, xxhash.xxh64_intdigest(low)


class Level(NamedTuple):
    """Tokens of some texts: which text each is of, kinds, hashes, the word that each begins at (and the number of words)."""

    owner: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray


def _slots(owner: np.ndarray, kind: np.ndarray, value: np.ndarray) -> Level:
    """The slots of words and operators."""
    word = kind != OPERATOR
    n_words = int(word.sum())
    starts = np.cumsum(word) - word
    behind = lambda x: np.concatenate([np.zeros(1, x.dtype), x[:-1]])
    near = lambda of: np.concatenate([[False], of[1:] == of[:-1]])[: len(of)]
    kind = np.where(kind == HYPHENATED, NUMBER, kind)
    number = (kind == NUMBER) | (kind == MEASURE)
    keep = word | (near(owner) & behind(number)[: len(kind)])
    owner, kind, value, starts = owner[keep], kind[keep].copy(), value[keep], starts[keep]
    if not len(kind):
        return Level(owner, kind, value, np.array([n_words]))
    same = near(owner)
    kind[kind == OPERATOR] = LITERAL
    kind[kind == CAPITALS] = NAME
    kind[kind == SHORT] = np.where((same & (behind(kind) == NUMBER))[kind == SHORT], UNIT, LITERAL)
    particle, name = kind == PARTICLE, kind == NAME
    ahead = lambda x: np.concatenate([x[1:], np.zeros(1, x.dtype)])
    follows, leads = same & behind(name), ahead(same & name)
    pair = particle & follows & ahead(same & particle & leads)
    kind[particle] = LITERAL
    kind[(particle & follows & leads) | pair | behind(pair)] = NAME
    before = behind(kind)
    united = same & (kind == UNIT) & (before == NUMBER)
    joins = united | (same & (kind == before) & ((kind == NAME) | (kind == NUMBER)))
    head = np.flatnonzero(~joins)
    group = np.cumsum(~joins) - 1
    kinds = kind[head]
    kinds[group[united]] = MEASURE
    place = np.arange(len(kind)) - head[group]
    hashes = np.add.reduceat(value * _powers(_BASE, int(place.max()) + 1)[place], head)
    return Level(owner[head], kinds, hashes, np.append(starts[head], n_words))


class Canonical:
    """Turns texts to template tokens; remembers words it has seen, a bounded number of them."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.kinds, self.hashes = np.zeros(0, np.int8), np.zeros(0, np.uint64)

    def _learn(self) -> None:
        """Look at the words that were numbered since the last time."""
        new = list(islice(reversed(self.numbers), len(self.numbers) - len(self.kinds)))[::-1]
        if new:
            kinds, hashes = zip(*map(_token, new), strict=True)
            self.kinds = np.concatenate([self.kinds, np.array(kinds, np.int8)])
            self.hashes = np.concatenate([self.hashes, np.array(hashes, np.uint64)])

    def tokens(self, texts: list[bytes]) -> tuple[Level, Level]:
        """(words, slots) of the texts; words without letter or digit are left out."""
        if len(self.numbers) > _CACHE_WORDS:
            self._reset()
        number, at, sizes = self.numbers.setdefault, [], []
        for text in texts:
            words = text.split()
            at += [number(w, len(self.numbers)) for w in words]
            sizes.append(len(words))
        at = np.array(at, np.int64)
        self._learn()
        kind, owner = self.kinds[at], np.repeat(np.arange(len(texts)), sizes)
        keep = kind != SKIP
        kind, owner, value = kind[keep], owner[keep], self.hashes[at[keep]]
        slots = _slots(owner, kind, value)
        word = kind != OPERATOR
        kind = np.where((kind >= CAPITALS) & word, LITERAL, kind).astype(np.int8)[word]
        return Level(owner[word], kind, value[word], np.arange(len(kind) + 1)), slots


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(kind: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(by template, by value) the hashes of each window of ``size`` tokens.

    Those by value don't depend on what is taken for a placeholder. A window that is almost
    all placeholders has only them: by itself its template says nothing.
    """
    n = len(kind) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _powers(_BASE, len(kind)), _powers(pow(_BASE, -1, 1 << 64), n)
    total = lambda x: np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    template = np.where(kind == LITERAL, value, _SLOT_HASH[kind])
    rolled = [(lambda c: (c[size:] - c[:n]) * down)(total(x * up)) for x in (template, value)]
    literals = (lambda c: c[size:] - c[:n])(total((kind == LITERAL).astype(np.int64)))
    rolled[1] = rolled[1] ^ np.uint64(0x5851F42D4C957F2D)
    rolled[0] = np.where(literals * WINDOW >= WINDOW_LITERALS * size, rolled[0], rolled[1])
    mixed = [((x := r + np.uint64(size)) ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) for r in rolled]
    return mixed[0] ^ (mixed[0] >> np.uint64(32)), mixed[1] ^ (mixed[1] >> np.uint64(32))


def slot_hashes(kind: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes by template, whether there are literals enough) of each window of ``size`` slots."""
    upto = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return window_hashes(kind, value, size)[0] ^ _SLOT_LEVEL, (upto[size:] - upto[: max(0, len(upto) - size)]) * WINDOW >= WINDOW_LITERALS * size


ITEM_SCHEMA = "item_id long, level int, item_tokens int, item_words int, kinds binary, words binary, starts binary, plain binary"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    canonical = Canonical()
    names = [x.split()[0] for x in ITEM_SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), string_column(batch, "text"), strict=True):
            both = canonical.tokens([text.as_buffer().to_pybytes()])
            plain = both[WORDS].hashes
            for level, x in enumerate(both):
                if len(plain):
                    parts = (x.kinds, x.hashes, x.starts.astype(np.int32), plain if level == SLOTS else plain[:0])
                    rows.append((item, level, len(x.kinds), len(plain), *(p.tobytes() for p in parts)))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def canonical_items(benchmark: DataFrame) -> DataFrame:
    """See ITEM_SCHEMA: the words and the slots of each item that has some, a row each."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, ITEM_SCHEMA)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["item_id", "level", "kinds", "words"]).to_pylist():
                kind, value = np.frombuffer(r["kinds"], np.int8), np.frombuffer(r["words"], np.uint64)
                size = min(window, len(kind))
                if r["level"] == WORDS:
                    at_each = [dict.fromkeys(two) for two in zip(*(x.view(np.int64).tolist() for x in window_hashes(kind, value, size)), strict=True)]
                else:
                    hashes, good = slot_hashes(kind, value, size)
                    at_each = [[h if g else None] for h, g in zip(hashes.view(np.int64).tolist(), good.tolist(), strict=True)]
                rows += [(h, r["item_id"], r["level"], at, len(kind)) for at, found in enumerate(at_each) for h in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "item_id", "level", "item_at", "item_tokens"])

    return run


def item_windows(items: DataFrame, window: int = WINDOW, least_run: int = LEAST_RUN, shared: int = SHARED) -> DataFrame:
    """(hash, item_id, level, item_at, item_tokens): the windows of the items that are joined.

    A run of ``least_run`` tokens has least_run - window + 1 windows in a row, a shorter item all
    of its own. Windows of more than ``shared`` items are left out where every such row has
    a rarer one, so boilerplate doesn't bring each item to each document. A window of slots with
    too few literals finds nothing and so counts as common.
    """
    rows = items.mapInArrow(_item_windows(window), "hash long, item_id long, level int, item_at int, item_tokens int")
    often = rows.where("hash IS NOT NULL").groupBy("hash").agg(F.count("*").alias("_n")).where(F.col("_n") > shared).select("hash", F.lit(True).alias("_often"))
    rows = rows.join(often, "hash", "left").withColumn("_often", F.col("_often") | F.col("hash").isNull())
    # a place of an item is common if all its hashes are; runs of common places are told apart by the rarer ones before
    places = rows.groupBy("item_id", "level", "item_tokens", "item_at").agg(F.bool_and(F.coalesce("_often", F.lit(False))).alias("_common"))
    before = Window.partitionBy("item_id", "level", "item_tokens").orderBy("item_at").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("_run", F.sum(F.when(F.col("_common"), 0).otherwise(1)).over(before))
    alike = Window.partitionBy("item_id", "level", "item_tokens", "_run", "_common")
    stretch = F.least(F.lit(least_run - window + 1), F.col("item_tokens") - F.least(F.lit(window), F.col("item_tokens")) + 1)
    needed = places.withColumn("_long", F.count("*").over(alike)).where(~F.col("_common") | (F.col("_long") >= stretch))
    kept = needed.select(F.col("item_id").alias("_item"), F.col("level").alias("_level"), F.col("item_tokens").alias("_tokens"), F.col("item_at").alias("_at"))
    same = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_at") == F.col("_at")) & (F.col("item_tokens") == F.col("_tokens")) & (F.col("level") == F.col("_level"))
    return rows.where("hash IS NOT NULL").join(kept, same, "left_semi").select("hash", "item_id", "level", "item_at", "item_tokens")


def _bit_map(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for each leading ``bits`` bits of a hash. Its words, not the benchmark's rows, come to the driver."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    rows = (
        windows.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    ).collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in rows:
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def _document_windows(bit_map, bits: int, sizes: list[tuple[int, int]]):
    names = ["doc_id", "th", "doc_at", "hash"]
    shift = np.uint64(64 - bits)

    def met(hashes: np.ndarray) -> np.ndarray:
        top = (hashes >> shift).astype(np.int64)
        return ((bit_map.value[top >> 3] >> (top & 7).astype(np.uint8)) & 1).astype(bool)

    def of(ids: list, hashes_of: list, texts: list[bytes], canonical: Canonical) -> pa.RecordBatch:
        both = canonical.tokens(texts)
        starts = [np.searchsorted(x.owner, np.arange(len(texts))) for x in both]
        texts_of, places, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for level, size in sizes:
            owner, kind, value, _ = both[level]
            if level == WORDS:
                by_template, by_value = window_hashes(kind, value, size)
                found = [(by_template, met(by_template)), (by_value, met(by_value) & (by_value != by_template))]
            else:
                hashes, good = slot_hashes(kind, value, size)
                found = [(hashes, met(hashes) & good)]
            for hashes, good in found:
                at = np.flatnonzero(good)
                at = at[owner[at] == owner[at + size - 1]]
                texts_of.append(owner[at])
                places.append(at - starts[level][owner[at]])
                hits.append(hashes[at])
        of_text = pa.array(np.concatenate(texts_of))
        columns = [pa.array(ids, pa.int64()).take(of_text), pa.array(hashes_of, pa.int64()).take(of_text)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(places)), pa.array(np.concatenate(hits).view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            ids, marks, texts, size = [], [], [], 0
            for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), string_column(batch, "text"), strict=True):
                data = text.as_buffer().to_pybytes()
                ids.append(doc)
                marks.append(th)
                texts.append(data)
                size += len(data)
                if size > _CHUNK_BYTES:
                    yield of(ids, marks, texts, canonical)
                    ids, marks, texts, size = [], [], [], 0
            if ids:
                yield of(ids, marks, texts, canonical)

    return run


_ALIGNED = "doc_id long, th long, item_id long, first int, doc_at long, doc_kinds binary, doc_words binary, doc_starts binary, doc_plain binary"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut what lies along each item out of the documents: from item token ``first`` on, from document word doc_at on."""
    canonical = Canonical()
    names = [x.split()[0] for x in _ALIGNED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    for batch in batches:
        for doc, th, text, found in zip(
            batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), string_column(batch, "text"), batch.column("found"), strict=True
        ):
            both = canonical.tokens([text.as_buffer().to_pybytes()])
            rows = []
            for x in found.as_py():
                first = max(0, -x["diagonal"])
                level = both[x["level"]]
                a, b = x["diagonal"] + first, min(x["diagonal"] + x["item_tokens"], len(level.kinds))
                starts = level.starts[a : b + 1]
                plain = both[WORDS].hashes[starts[0] : starts[-1] if x["level"] == SLOTS else starts[0]]
                parts = (level.kinds[a:b], level.hashes[a:b], (starts - starts[0]).astype(np.int32), plain)
                rows.append((doc, th, x["item_id"], first, int(starts[0]), *(p.tobytes() for p in parts)))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def consistent_runs(matches: list[tuple[int, list, list]], literal: frozenset[int] = frozenset()) -> list[tuple[int, int, bool]]:
    """(first item token, number of tokens, whether all are equal) of each longest run on one diagonal.

    ``matches`` are stretches (item position, item words, document words) in order. Words that
    differ are values of placeholders; a run ends where an item's value stands for two values of
    the document, and the next begins after the earlier of the two places. Two values of the
    item may have become one. Item positions in ``literal`` have no value.
    """
    pairs: dict[int, tuple] = {}
    for at, item, doc in matches:
        pairs.update((at + i, x) for i, x in enumerate(zip(item, doc, strict=True)))
    runs, start, last, unlike = [], None, None, -1
    there: dict = {}
    for at in sorted(pairs):
        a, b = pairs[at]
        after = start
        if start is None or at != last + 1:
            after, there = at, {}
        elif at not in literal:
            other, seen = there.get(a, (b, -1))
            after = max(after, seen + 1) if other != b else after
        if after != start:
            if start is not None:
                runs.append((start, last + 1 - start, unlike < start))
            start = after
        if at not in literal:
            there[a] = (b, at)
        unlike, last = at if a != b else unlike, at
    if start is not None:
        runs.append((start, last + 1 - start, unlike < start))
    return runs


def _stretches(good: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def best_run(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], first: int, least: int) -> tuple[int, int, bool] | None:
    """(tokens, first item token, exact) of the longest run that is contamination, if there is one.

    ``item`` and ``doc`` are (kinds, words); ``doc`` begins along item token ``first``.
    """
    kinds, words = (x[first : first + len(doc[0])] for x in item)
    equal = words == doc[1]
    literal = equal & (kinds == LITERAL)
    runs = [(b - a, a, True) for a, b in _stretches(equal) if b - a >= least]
    upto = np.concatenate([[0], np.cumsum(literal)])
    for a, b in _stretches(equal | ((kinds == doc[0]) & (kinds != LITERAL))):
        if b - a < least:
            continue
        fixed = frozenset(np.flatnonzero(literal[a:b]).tolist())
        for at, n, exact in consistent_runs([(0, words[a:b].tolist(), doc[1][a:b].tolist())], fixed):
            if n >= least and not exact and upto[a + at + n] - upto[a + at] >= max(RUN_LITERALS, LITERAL_SHARE * n):
                runs.append((n, a + at, False))
    if not runs:
        return None
    n, at, exact = max(runs, key=lambda x: (x[0], x[2], -x[1]))
    return n, first + at, exact


def best_slots(item: tuple[np.ndarray, ...], doc: tuple[np.ndarray, ...], first: int, least: int) -> tuple[int, int, int] | None:
    """(words of the item, its first one, first word of ``doc``) of the longest run of ``least`` slots with other values, if there is one.

    ``item`` and ``doc`` are (kinds, slots, starts, words); ``doc`` begins along item slot ``first``. Names with equally many words
    have to be consistent word by word, as do a number and its unit; numbers of several words and other slots as a whole.
    """
    n = len(doc[0])
    kinds, slots, starts = item[0][first : first + n], item[1][first : first + n], item[2][first : first + n + 1]
    equal = slots == doc[1]
    literal = equal & (kinds == LITERAL)
    upto = np.concatenate([[0], np.cumsum(literal)])
    unlike = np.concatenate([[0], np.cumsum(~equal)])
    best = None
    for a, b in _stretches(equal | ((kinds == doc[0]) & (kinds != LITERAL))):
        if b - a < least:
            continue
        # what is compared: the words of each slot, or the slot
        ours, theirs, edges, fixed = [], [], [0], []
        for k in range(a, b):
            i, j = slice(starts[k], starts[k + 1]), slice(doc[2][k], doc[2][k + 1])
            if literal[k]:
                fixed.append(len(ours))
            whole = kinds[k] != NAME and i.stop - i.start > (kinds[k] == MEASURE) + 1
            if not literal[k] and not whole and i.stop - i.start == j.stop - j.start:
                ours += item[3][i].tolist()
                theirs += doc[3][j].tolist()
            else:
                ours.append(int(slots[k]))
                theirs.append(int(doc[1][k]))
            edges.append(len(ours))
        for at, size, _ in consistent_runs([(0, ours, theirs)], frozenset(fixed)):
            x, y = a + int(np.searchsorted(edges, at)), a + int(np.searchsorted(edges, at + size, "right")) - 1
            if y - x >= least and unlike[y] > unlike[x] and upto[y] - upto[x] >= max(RUN_LITERALS, LITERAL_SHARE * (y - x)):
                best = max(best or (0, 0, 0), (int(starts[y] - starts[x]), -int(starts[x]), int(doc[2][x])))
    return best and (best[0], -best[1], best[2])


FOUND_SCHEMA = "doc_id long, item_id long, item_tokens long, matched_tokens long, item_at long, doc_at long, exact boolean"
_RUN_SCHEMA = "doc_id long, th long, same long, item_tokens long, matched_tokens long, item_at long, doc_at long, exact boolean"


def _verify(least: int):
    names = [x.split()[0] for x in _RUN_SCHEMA.split(", ")]
    parts = (("kinds", np.int8), ("words", np.uint64), ("starts", np.int32), ("plain", np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                item, doc = (tuple(np.frombuffer(r[before + x], kind) for x, kind in parts) for before in ("", "doc_"))
                enough = min(least, r["item_tokens"])
                if r["level"] == WORDS:
                    found = best_run(item[:2], doc[:2], r["first"], enough)
                    found = found and (found[0], found[1], found[1] - r["first"], found[2])
                else:
                    found = best_slots(item, doc, r["first"], enough)
                    found = found and (*found, False)
                if found:
                    n, at, behind, exact = found
                    rows.append((r["doc_id"], r["th"], r["item_id"], r["item_words"], n, at, r["doc_at"] + behind, exact))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 7 + [pa.bool_()], strict=True)], names)

    return run


def _runs(docs: DataFrame, benchmark: DataFrame, window: int, least_run: int) -> DataFrame:
    """FOUND_SCHEMA with ``th``, the hash of the text; a row per text, item and diagonal."""
    spark = docs.sparkSession
    items = written(canonical_items(benchmark), "benchmark-items")
    # items of equal tokens are one here, and all of them again in the result
    once = items.withColumn("same", F.xxhash64("level", "kinds", "words", "starts", "plain"))
    members = once.select("same", F.col("item_id").alias("_member"))
    kept = ("item_words", "kinds", "words", "starts", "plain")
    once = once.groupBy(F.col("same").alias("item_id"), "level", "item_tokens").agg(*(F.first(c).alias(c) for c in kept))
    windows = written(item_windows(once, window, least_run), "benchmark-windows")
    stats = windows.agg(F.count("*").alias("n"), F.collect_set(F.struct("level", F.least(F.col("item_tokens"), F.lit(window)).cast("int").alias("size"))).alias("sizes")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, BITS_EACH + int(stats["n"]).bit_length()))
    bit_map = spark.sparkContext.broadcast(_bit_map(windows, bits))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = texts.mapInArrow(_document_windows(bit_map, bits, sorted((x["level"], x["size"]) for x in stats["sizes"])), "doc_id long, th long, doc_at long, hash long")
    small = stats["n"] <= BROADCAST_WINDOWS
    diagonal = F.struct("item_id", "level", "item_tokens", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    candidates = found.join(F.broadcast(windows) if small else windows, "hash").groupBy("doc_id", "th").agg(F.collect_set(diagonal).alias("found"))
    candidates = written(candidates, "benchmark-candidates").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "found")
    met = texts.join(candidates, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "th", "text", "found")
    aligned = met.mapInArrow(_aligned, _ALIGNED)
    once = once.select("item_id", "level", "item_tokens", *kept)
    aligned = aligned.join(F.broadcast(once) if small else once, "item_id")
    runs = aligned.mapInArrow(_verify(least_run), _RUN_SCHEMA)
    return runs.join(members, "same").withColumnRenamed("_member", "item_id").drop("same")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_run: int = LEAST_RUN) -> DataFrame:
    """One row per contaminated document and item: its longest run of matching tokens; see FOUND_SCHEMA.

    exact says whether the run has the item's own values. Positions and lengths count words
    with a letter or digit; of an item's slots as many have to agree as of its words. Null and empty texts match nothing, nor do items without words;
    repeated items match each; repeated rows give one row together; null doc_ids and item_ids
    are kept. Other columns are not read. No documents or no items: no rows.
    """
    best = F.max(F.struct("matched_tokens", "exact", (-F.col("doc_at")).alias("before"), "item_at", "item_tokens")).alias("best")
    return (
        _runs(docs, benchmark, window, least_run)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            "best.item_tokens",
            "best.matched_tokens",
            "best.item_at",
            (-F.col("best.before")).alias("doc_at"),
            "best.exact",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_run: int = LEAST_RUN) -> DataFrame:
    """The documents in whose text no item is found, columns unchanged.

    A run of fewer than ``least_run`` words, which is a whole short item, counts only with the item's own values: "the
    capital of Spain" isn't "the capital of France". Each row is judged by its own text, whatever other rows have its doc_id, or none. Null and
    empty texts stay; no benchmark or no documents: nothing goes; columns of any name may be there.
    """
    id_, th = fresh(docs, "_id", "_th")
    bad = _runs(docs, benchmark, window, least_run).where(F.col("exact") | (F.col("matched_tokens") >= least_run)).select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    own: Column = F.xxhash64("text") == F.col(th)
    return docs.join(bad, own & F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
