"""Groups of several kinds of links: SimHash and exact similarity in the pipeline."""

import corpus_pipeline

from recollect.llm import simhash
from recollect.llm.components import merged_groups
from tests.llm import tricky


def test_fingerprints_link_in_the_pipeline(spark):
    """Texts that repeat one passage and end apart: one fingerprint, few distinct shingles in common."""
    passage = " ".join(f"w{i}" for i in range(11))
    a, b = (f"{' '.join([passage] * 50)} {tricky.text(seed, 30)}" for seed in (601, 602))
    assert (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() <= simhash.THRESHOLD
    other = tricky.text(603, 60)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in ((5, a), (3, b), (9, other), (None, tricky.text(604, 40)))], tricky.SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {3, 9, None}


def test_merged_groups(spark):
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, component_id long")
    one = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (None, None)]
    two = [(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 5), (None, None)]
    want = {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}
    assert {tuple(r) for r in merged_groups(made(one), made(two)).collect()} == want | {(None, None)}
    two[-1] = (None, 4)
    assert {tuple(r) for r in merged_groups(made(one), made(two)).collect()} == want | {(None, 4)}
    # of an id with two texts one names its group
    assert {tuple(r) for r in merged_groups(made([(1, 1), (2, 1), (2, 2)]), made([(1, 1), (2, 2), (2, 2)])).collect()} == {(1, 1), (2, 2)}
    assert merged_groups(made([]), made([])).collect() == []
