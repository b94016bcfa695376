"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker is given at a time.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For rows of some hundred KB: Parquet looks at a page's size after 100 rows, and packs and unpacks whole pages outside the heap.
_WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; keyword names use ``__`` for ``.``."""
    builder = (
        SparkSession.builder.master(master)
        .appName("recollect")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is missing on a single machine (as in tests) a temporary folder is
    chosen and remembered in the session; on a cluster there is no such folder to choose.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("recollect.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("recollect.scratch.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Spark hands Python about ``most`` bytes of rows at a time, unless the session itself says how many.

    By default it is 10,000 rows or 64 MB: of documents of some KB each an executor holds tens of MB
    for each task several times, in the JVM, on the way and in Python.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(most))


def written(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation. ``wide``: rows are
    so large that pages and row groups are to be cut row by row.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(_WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
