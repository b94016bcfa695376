"""The pipeline's stages over the awkward table and against a plain version of each decision."""

import corpus_pipeline
import pyarrow as pa
import pytest

from recollect.llm import queries
from recollect.session import BATCH_BYTES
from tests.llm import tricky

JUNK = " ".join(f"{w}###" for w in tricky.text(50, 60).split())
LEAK = "winter copper market silver yellow river stone window garden letter music of the winter river"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    made = [(i, tricky.text(i, 80), "en", f"s{i % 3}", 0) for i in range(100, 220)]
    made += [(i, " ".join(f"{w}{'#$%'[i % 3] * 3}" for w in tricky.text(i, 80).split()), "en", "s0", 0) for i in range(300, 340)]
    made += [(1000, f"{tricky.text(1000, 50)} {LEAK} {tricky.text(1001, 20)}", "en", "s1", 0), (1001, tricky.text(7, 90) + " token = 'abcdefgh0123'", "en", "s2", 0)]
    docs = spark.createDataFrame([r for r in tricky.ROWS if r[0] != 9] + made, tricky.SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 340), 0) for i, *_ in made], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == (docs.columns if name != "source mixing" else [*docs.columns, "copy"])
        rows = out.collect()
        seen[name] = rows
        docs = spark.createDataFrame([tuple(r)[:5] for r in rows], tricky.SCHEMA)
    kept = [{r.doc_id for r in rows} for rows in seen.values()]
    assert not kept[0] & set(range(300, 340)) and set(range(100, 220)) <= kept[0]
    assert 2 not in kept[1] and 1 in kept[1] and set(range(100, 220)) <= kept[1]
    assert kept[1] - kept[2] == {1000}
    assert kept[3] == kept[2] and "[SECRET]" in next(r.text for r in seen["secret scans"] if r.doc_id == 1001)
    assert all(r.copy in (1, 2) for r in seen["source mixing"])
    a = sorted((str(r.doc_id), r.text or "", r.copy) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert a == sorted((str(r.doc_id), r.text or "", r.copy) for r in seen["source mixing"])


def test_near_copies_go(spark):
    text = tricky.text(400, 50).split()
    near = [*text[:25], "changed", *text[26:]]
    docs = spark.createDataFrame([(1, " ".join(text), "en", "a", 0), (2, " ".join(near), "en", "a", 0)], tricky.SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES if q.startswith("op")} and "pipeline" in queries.QUERIES
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_python_is_given_few_bytes_at_a_time(spark):
    """Of documents of 5 KB no more than some MB meet in a batch, whatever their number."""
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat('x', 5000) AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars").coalesce(1)
    corpus_pipeline.mask_secrets(spark, docs, "")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * BATCH_BYTES
