"""The stored text index against brute force, through insertions, deletions and merges."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from recollect.sources.text_index import TextIndex
from recollect.sources import text_index

WORDS = "the of and café river stone windöw garden letter musik winter niño 42 snake_case Ελλάδα".split() + [f"w{i}" for i in range(60)]


def terms(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"\w+", plain)


def best(rows, queries, limit, match="any", among=None):
    own = {i: Counter(terms(t)) for i, t in rows.items() if t is not None}
    n, length = len(rows), sum(sum(c.values()) for c in own.values())
    df = Counter(t for c in own.values() for t in c)
    mean = max(length, 1) / max(n, 1)
    out = []
    for q, text in queries:
        # the words of the query syntax go; what is left is ASCII
        asked = {t for t in terms(text or "") if t.isascii() and t not in ("and", "or", "not", "near")}
        scored = []
        for i, c in own.items():
            hit = [t for t in asked if c[t]]
            if not hit or (match == "all" and len(hit) < len(asked)) or (among is not None and i not in among):
                continue
            idf = lambda t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6)
            scored.append((-round(sum(idf(t) * 2.2 * c[t] / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in hit), 9), i))
        out += [(q, i, rank, -s) for rank, (s, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def text(rng, n):
    return " ".join(WORDS[min(int(rng.paretovariate(0.7)) - 1, len(WORDS) - 1)] for _ in range(n))


def found(index, spark, queries, limit, **how):
    df = spark.createDataFrame(queries, "query_id long, text string")
    return sorted((r.query_id, r.id, r.rank, round(r.bm25, 9)) for r in index.search(df, limit, **how).collect())


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(a, b, strict=True))


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, text string").repartition(3)


def test_search_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "CHUNK_ROWS", 64)
    monkeypatch.setattr(text_index, "DIRECT_POSTINGS", 0)
    monkeypatch.setattr(text_index, "SEED_POSTINGS", 40)
    rng = random.Random(1)
    rows = {i: text(rng, rng.randint(1, 60)) for i in range(400)} | {400: None, 401: "", 402: "cafe!"}
    queries = [(i, text(rng, rng.randint(1, 8))) for i in range(8)] + [(50, "Cafe"), (51, "nothing"), (52, None), (53, "cafe winter"), (54, "")]
    index = TextIndex.create(frame(spark, rows), str(tmp_path / "index"))
    close(found(index, spark, queries, 5), best(rows, queries, 5))
    close(found(index, spark, queries, 5, match="all"), best(rows, queries, 5, "all"))
    few = set(range(0, 400, 7))
    close(found(index, spark, queries, 3, among=spark.createDataFrame([(i,) for i in few], "id long")), best(rows, queries, 3, among=few))
    # long texts come and some go, so that the mean and what the stored bounds were made for change
    more = {i: text(rng, 200) for i in range(500, 540)}
    index.insert(frame(spark, more))
    gone = {i: rows[i] for i in range(0, 400, 3)}
    index.delete(frame(spark, gone))
    now = {i: t for i, t in (rows | more).items() if i not in gone}
    close(found(index, spark, queries, 5), best(now, queries, 5))
    old, new = {i: now[i] for i in (1, 2, 500)}, {1: "winter cafe", 2: None, 500: "stone"}
    index.update(frame(spark, old), frame(spark, new))
    now |= new
    close(found(index, spark, queries, 5), best(now, queries, 5))
    monkeypatch.setattr(text_index, "DIRECT_POSTINGS", 10**9)
    close(found(index, spark, queries, 5), best(now, queries, 5))
    index.merge()
    assert len(index._runs()) == 1
    close(found(index, spark, queries, 5), best(now, queries, 5))
    index.insert(frame(spark, {900: "cafe cafe cafe"}))
    now[900] = "cafe cafe cafe"
    close(found(index, spark, queries, 5), best(now, queries, 5))


def test_a_run_that_was_not_committed_is_not_read(spark, tmp_path):
    index = TextIndex.create(frame(spark, {1: "river stone", 2: "river"}), str(tmp_path / "index"))
    # a writer that died after its postings
    src = index._read("postings", text_index.POSTINGS).drop("run")
    src.write.parquet(str(tmp_path / "index" / "postings" / "run=1"))
    close(found(index, spark, [(1, "river")], 5), best({1: "river stone", 2: "river"}, [(1, "river")], 5))
    index.insert(frame(spark, {3: "stone"}))
    close(found(index, spark, [(1, "river stone")], 5), best({1: "river stone", 2: "river", 3: "stone"}, [(1, "river stone")], 5))


def test_frequent_words_are_mostly_skipped(spark, tmp_path):
    rng = random.Random(2)
    rows = {i: text(rng, 40) + (f" rare{i}" if i % 50 == 0 else "") for i in range(3000)}
    index = TextIndex.create(frame(spark, rows), str(tmp_path / "index"))
    queries = [(i, f"the of and rare{i * 50} w{i}") for i in range(10)]
    close(found(index, spark, queries, 3), best(rows, queries, 3))
    cost = index.cost(spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    with_a_term = [sum(bool({*terms(t)} & {*terms(q)}) for t in rows.values()) for _, q in queries]
    assert sum(r.scored or 0 for r in cost) < 0.3 * sum(with_a_term)
    assert all(r.read <= r.postings for r in cost)


def test_nothing_to_search(spark, tmp_path):
    index = TextIndex.create(frame(spark, {1: None}), str(tmp_path / "index"))
    assert found(index, spark, [(1, "river")], 5) == []
    index.insert(frame(spark, {2: "river"}))
    assert [x[:3] for x in found(index, spark, [(1, "river")], 5)] == [(1, 2, 1)]


@pytest.mark.parametrize("match", ["any", "all"])
def test_search_in_an_empty_index(spark, tmp_path, match):
    index = TextIndex.create(frame(spark, {1: "x"}).limit(0), str(tmp_path / "index"))
    assert found(index, spark, [(1, "river")], 5, match=match) == []


def test_a_pass_over_the_texts_finds_what_the_index_finds(spark, tmp_path, monkeypatch):
    """Equal texts, a null, an empty one, unknown terms, scopes; no index is made for few queries, one for many."""
    from recollect.sources import text_scan

    words = ["river", "stone", "tree", "café", "sun", "moon"]
    texts = [None, ""] + [" ".join(words[(i * j + j) % 6] for j in range(1 + i % 7)) for i in range(60)] + ["river stone"] * 30
    rows = spark.createDataFrame([(i, t, "ab"[i % 2] if i % 9 else None) for i, t in enumerate(texts)], "id long, text string, s string").repartition(3)
    asked = spark.createDataFrame([(1, "river stone", "a"), (2, "Cafe sun nowhere", "b"), (3, "tree", None), (4, "", "a"), (5, "moon sun", "a")], "query_id long, text string, s string")
    scan = text_scan.TextScan(rows.select("id", "text"), str(tmp_path / "scan"))
    index = TextIndex.create(rows.select("id", "text"), str(tmp_path / "index"))
    get = lambda of, *a: sorted((r.query_id, r["rank"], r.id, round(r.bm25, 9)) for r in of.search(asked, 4, *a).collect())
    for a in (("any",), ("all",), ("any", rows.where("id % 3 > 0")), ("any", rows, ("s",))):
        assert get(scan, *a) == get(index, *a), a
    assert get(scan, "any") and not (tmp_path / "scan").exists()
    monkeypatch.setattr(text_scan, "MOST_TERMS", 2)
    assert get(scan, "any") == get(index, "any") and (tmp_path / "scan").exists()
