"""Phrases, repeats and ranked search against brute force, over the awkward table, hot keys and nothing."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import lexical, phrases, repeats
from tests.llm import tricky

ENGLISH = "of the in a to and old new york city river stone".split()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentences(rng, n):
    return "".join(rng.choice(ENGLISH) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for _ in range(n))


def phrases_by_hand(docs, top=2000, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [q for q in counts if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and counts[q] >= least]
            if not any(100 * counts[q] >= 50 * a for q in around):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_phrases(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(rng.choice(["en", "de", None]), sentences(rng, 80) + rng.choice(["", "New York City. ", "!!", "é ß Ü é ß "])) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("xx", "   ..."), ("fr", "A B a b" * 20)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    want = phrases_by_hand(docs)
    assert len(want) > 20
    assert sorted(map(tuple, phrases.mine(df).collect())) == want
    monkeypatch.setattr(phrases, "CELLS", 1e-9)  # a sketch so narrow that nearly everything is a candidate
    assert sorted(map(tuple, phrases.mine(df, top=5).collect())) == phrases_by_hand(docs, top=5)


def test_phrases_of_many_languages(spark):
    rng = random.Random(4)
    docs = [(f"l{i % 5}", sentences(rng, 120)) for i in range(60)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrases.mine(df).collect())) == phrases_by_hand(docs)


def test_phrases_of_the_awkward_table(spark):
    want = phrases_by_hand([(r[2], r[1]) for r in tricky.ROWS])
    assert sorted(map(tuple, phrases.mine(tricky.documents(spark)).collect())) == want
    assert phrases.mine(tricky.empty(spark)).count() == 0


def test_scores_are_exact(spark):
    """a * a * 10^6 passes 64 bits."""
    a, left, right = 3_000_000_007, 3_000_000_011, 9_000_000_001
    sums = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], phrases.COUNT_SCHEMA)
    sizes = spark.createDataFrame([("en", 10)], "lang string, n long")
    (row,) = phrases.ranked(sums, sizes).collect()
    assert row.score == 1000000 * a * a // (left * right)


def removed_by_hand(docs, length):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(data[s : s + length])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def repeating(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(10, 80)) for _ in range(6)]
    docs = [(None, passages[0] + passages[1]), (9999, ""), (9998, None), (9997, "ab" * 400), (9996, "a" * 700), (9995, "a\0" * 150)]
    for i in range(n):
        t = "".join(rng.choice([text(rng.randint(1, 40)), rng.choice(passages), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))
        docs += [(i, t)] + [(i + 1000, t)] * (rng.random() < 0.2) + [(i + 2000, t[:50] + "x" + t[51:])] * (rng.random() < 0.2)
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("how", [{"length": 100}, {"length": 30, "gram": 12, "hot": 3, "fan": 2, "block_bytes": 8000}, {"length": 30, "gram": 29, "fan": 3, "block_bytes": 5000}])
def test_repeats(spark, how):
    docs = repeating(how["length"], 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = repeats.digests(repeats.remove(df, **how))
    same(map(tuple, got.collect()), removed_by_hand(docs, how["length"]))


def test_repeats_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1000)
    texts = [(t or "").encode() for _, t in repeating(7, 20)]
    own = repeats.Segments(texts, 100, 32)
    every = sorted(i for a, b in zip(own.first, own.last, strict=True) for i in range(a, b + 1))
    ends = np.cumsum([len(t) for t in texts])
    assert every == [i for e, t in zip(ends, texts, strict=True) for i in range(e - len(t), e - 99)]


def test_repeats_of_the_awkward_table(spark):
    """Rows of one id go in the order they are packed in, so what of them is kept is compared together."""
    got = repeats.digests(repeats.remove(tricky.documents(spark))).collect()
    want = removed_by_hand([r[:2] for r in tricky.ROWS], 100)
    once = lambda x: [r for r in x if r[0] not in (3, None)]
    same(once(map(tuple, got)), once(want))
    total = lambda x: sorted((str(r[0]), r[1]) for r in x)
    assert total(got) == total(want)
    assert sum(r[2] for r in got) == sum(r[2] for r in want)
    assert repeats.remove(tricky.empty(spark)).count() == 0


def test_intervals_are_the_maximal_repeats():
    rng = random.Random(2)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(2, 5))]
        suffixes = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
        own = [texts[i][j:] for i, j in suffixes]
        order = sorted(range(len(own)), key=own.__getitem__)
        lcp = repeats.common_prefixes(texts, own, order)
        left = [texts[i][j - 1] if j else -1 for i, j in (suffixes[k] for k in order)]
        got = {}
        for size, a, b in repeats.maximal_repeats(lcp.tolist(), left, 3):
            i, j = suffixes[order[a]]
            got[texts[i][j : j + size]] = sorted(suffixes[k] for k in order[a : b + 1])
        at = defaultdict(list)
        for i, t in enumerate(texts):
            for j in range(len(t)):
                for e in range(j + 3, len(t) + 1):
                    at[t[j:e]].append((i, j))
        diverse = lambda of, step: len({texts[i][step(j)] if 0 <= step(j) < len(texts[i]) else ("end", i, j) for i, j in of}) > 1
        want = {w: sorted(of) for w, of in at.items() if len(of) > 1 and diverse(of, lambda j: j - 1) and diverse(of, lambda j, n=len(w): j + n)}
        assert got == want


def test_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(140)
    docs = [(i, text(50) + passage + text(60)) for i in range(8)] + [(8, text(400)), (9, None)]
    by = defaultdict(set)
    sizes = {}
    for r in repeats.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        by[r.repeat].add((r.doc_id, r.start))
        sizes[r.repeat] = r.length
    assert by
    covered = set()
    for name, of in by.items():
        assert len({docs[d][1][s : s + sizes[name]] for d, s in of}) == 1
        assert len(of) > 1
        if {d for d, _ in of} < set(range(8)):
            continue  # some share a letter beside the passage by chance
        covered |= {s + k - docs[d][1].index(passage) for d, s in of for k in range(sizes[name])}
    assert covered == set(range(140))


def best_by_hand(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for q, text in items:
        asked[q] |= set(terms(text))
    out = []
    for q, wanted in asked.items():
        hits = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(q, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_bytes", [300, 20_000, 10**9])
def test_search(spark, shard_bytes):
    rng = random.Random(6)
    docs = [(rng.choice([i, None] if i % 9 == 0 else [i]), sentences(rng, rng.randint(0, 60)) + rng.choice(["", "é42 ß", "rare" + str(i)])) for i in range(150)]
    docs += [(i + 500, t) for i, t in docs if i is not None and i % 3 == 0]  # ties
    docs += [(900, None), (901, ""), (902, " .,;"), (903, "STONE " * 500), (3, docs[5][1])]
    items = [(i, sentences(rng, 8)) for i in range(12)] + [(20, "Rare5 é42"), (21, None), (22, "nothing-of-it?"), (23, "..."), (0, "rare7"), (24, " ".join(t or "" for _, t in docs))]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes)
    queries = spark.createDataFrame(items, "query_id long, text string")
    for k in (10, 1):
        same(map(tuple, lexical.search(index, queries, k).collect()), best_by_hand(docs, items, k))
    same(map(tuple, lexical.search(index, queries, 10, query_bytes=60).collect()), best_by_hand(docs, items, 10))


def test_search_of_the_awkward_table(spark):
    items = [(1, "river stone window"), (2, "Élève ß"), (3, "one x"), (None, "token")]
    queries = spark.createDataFrame(items, "query_id long, text string")
    got = lexical.search(lexical.build(tricky.documents(spark)), queries).collect()
    same(map(tuple, got), best_by_hand([r[:2] for r in tricky.ROWS], items, 10))
    assert lexical.search(lexical.build(tricky.empty(spark)), queries).count() == 0
    assert lexical.search(lexical.build(tricky.documents(spark)), queries.limit(0)).count() == 0


def test_wavelet_ranges_are_those_of_the_documents():
    rng = np.random.default_rng(1)
    for docs in (1, 2, 3, 17):
        places = rng.integers(0, docs, 50)
        bits = lexical.wavelet(places, docs)
        levels = max(1, (docs - 1).bit_length())
        assert bits.shape[0] == levels
        first, last = 10, 40
        for d in range(docs):
            a, b = first, last
            for level in range(levels):
                own = np.unpackbits(bits[level], count=50).astype(int)
                one = (d >> (levels - 1 - level)) & 1
                rank = lambda x, own=own: int(own[:x].sum())
                a, b = (50 - own.sum() + rank(a), 50 - own.sum() + rank(b)) if one else (a - rank(a), b - rank(b))
            assert b - a == (places[first:last] == d).sum()
