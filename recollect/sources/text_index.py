"""A stored full-text index: postings by term and impact, ranked search that skips what can't enter the top.

A folder has a run for each change: ``postings``, ``terms`` (document frequencies, negative for
deletions) and ``gone`` (ids whose earlier postings are dead), and a row in ``runs``, which is written
last and so commits it. A search reads committed runs only; ``merge`` makes one of all.

A row of postings is a chunk of one term and one tier: a posting's impact, tf / (tf + K1 (1 - B +
B len / mean)), in ``TIERS`` equal steps, so chunks of a frequent word that matter little are apart
from those that do. Chunks are by hash of the id, so no word is a hot key, however frequent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.session import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TIERS, CHUNK_ROWS = 16, 8192
#: Postings that are looked at for a first estimate of a query's k-th score, and candidates scored for it.
SEED_POSTINGS, SEED_ROWS = 1000, 4
#: Up to so many postings of all queries' terms are added up as they are, which then is less work than finding out what to skip.
DIRECT_POSTINGS = 20_000_000

POSTINGS = "term string, tier int, chunk long, chunks long, mean double, n long, peak double, posts array<struct<id: long, tf: long, len: int>>, run long"
TERMS = "term string, df long, run long"
GONE = "id long, run long"
RUNS = "run long, replaces boolean, n long, length long, chunks long"


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def counted(rows: DataFrame) -> DataFrame:
    """(id, term, tf, len) of the terms of rows (id, text)."""
    words = rows.select("id", X.tokens(F.col("text")).alias("words"))
    found = words.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    return found.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def _within(asked: DataFrame, among: DataFrame | None, by: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """Leaves of rows with (query_id, id) those that the query may have."""
    if among is None:
        return lambda found: found
    if not by:
        return lambda found: found.join(among.select("id"), "id", "left_semi")
    scopes = asked.select("query_id", *by).distinct()
    return lambda found: found.join(among.select("id", *by), "id").join(scopes, ["query_id", *by], "left_semi").drop(*by)


@dataclass
class TextIndex:
    """Index of (id, text); an id is in it once. ``create`` makes one, ``insert`` and ``delete`` add runs."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, rows: DataFrame, path: str) -> TextIndex:
        index = cls(rows.sparkSession, path)
        index._write(rows, 0, 1, replaces=True)
        return index

    def insert(self, rows: DataFrame) -> None:
        """Add rows (id, text); where an id is there already, delete its old text first."""
        self._write(rows, self._next(), 1)

    def delete(self, rows: DataFrame) -> None:
        """Take out rows (id, text); their texts tell which frequencies fall."""
        self._write(rows, self._next(), -1)

    def update(self, old: DataFrame, new: DataFrame) -> None:
        self.delete(old)
        self.insert(new)

    def merge(self) -> None:
        """Make one run of all; earlier ones stay in the folder, unread."""
        live = written(self._posts(self._read("postings", POSTINGS)).select("id", "term", "tf", "len"), "index-live")
        self._store(live, self._next(), 1, True, self._sizes())

    def _runs(self) -> list:
        """Committed runs from the last that replaces all on; one small row for each change since ``merge``."""
        runs = sorted(self.spark.read.schema(RUNS).parquet(f"{self.path}/runs").collect(), key=lambda r: r["run"])
        first = max(i for i, r in enumerate(runs) if r["replaces"])
        return runs[first:]

    def _next(self) -> int:
        return self._runs()[-1]["run"] + 1

    def _sizes(self) -> tuple[int, int]:
        runs = self._runs()
        return sum(r["n"] for r in runs), sum(r["length"] for r in runs)

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/run={r['run']}" for r in self._runs()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths)

    def _write(self, rows: DataFrame, run: int, sign: int, replaces: bool = False) -> None:
        found = written(counted(rows.where("text IS NOT NULL")), "index-terms")
        n, length = rows.count(), found.agg(F.sum("tf")).first()[0] or 0
        self._store(found, run, sign, replaces, (sign * n, sign * length), rows.select("id"))

    def _store(self, found: DataFrame, run: int, sign: int, replaces: bool, sizes: tuple[int, int], ids: DataFrame | None = None) -> None:
        at = lambda what: f"{self.path}/{what}/run={run}"
        before = (0, 0) if replaces else self._sizes()
        n, length = before[0] + sizes[0], before[1] + sizes[1]
        mean, chunks = max(length, 1) / max(n, 1), max(1, -(-max(n, 1) // CHUNK_ROWS))
        found.groupBy("term").agg((sign * F.count("*")).alias("df")).write.mode("overwrite").parquet(at("terms"))
        gone = ids if sign < 0 else found.select("id").limit(0)
        gone.write.mode("overwrite").parquet(at("gone"))
        part = _impact(F.col("tf"), F.col("len"), F.lit(float(mean)))
        dealt = found.where(F.lit(sign > 0)).select(
            "term", F.least(F.floor(part * TIERS), F.lit(TIERS - 1)).cast("int").alias("tier"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("long").alias("chunk"), part.alias("part"), F.struct("id", "tf", "len").alias("post")
        )
        packed = dealt.groupBy("term", "tier", "chunk").agg(F.count("*").alias("n"), F.max("part").alias("peak"), F.sort_array(F.collect_list("post")).alias("posts"))
        packed = packed.select("term", "tier", "chunk", F.lit(chunks).cast("long").alias("chunks"), F.lit(float(mean)).alias("mean"), "n", "peak", "posts")
        packed.repartitionByRange("term", "tier", "chunk").sortWithinPartitions("term", "tier", "chunk").write.mode("overwrite").parquet(at("postings"))
        row = self.spark.createDataFrame([(run, replaces, sizes[0], sizes[1], chunks)], RUNS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")  # commits the run

    def _posts(self, packed: DataFrame) -> DataFrame:
        """The living postings of rows of postings, other columns kept."""
        kept = [c for c in packed.columns if c not in ("posts", "n", "peak", "chunk", "chunks", "mean")]
        found = packed.select(*kept, F.explode("posts").alias("p")).select(*kept, "p.id", "p.tf", "p.len")
        if all(r["replaces"] or r["n"] >= 0 for r in self._runs()):
            return found
        gone = self._read("gone", GONE).groupBy("id").agg(F.max("run").alias("dead"))
        return found.join(gone, "id", "left").where(F.col("dead").isNull() | (F.col("dead") < F.col("run"))).drop("dead")

    def weights(self, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, term, weight, terms): each query's terms once, by rarity; ``terms`` counts those asked for, known or not."""
        n, _ = self._sizes()
        asked = queries.select("query_id", *by, F.array_distinct(X.tokens(X.search_terms(X.folded(F.col("text"))))).alias("words"))
        asked = asked.select("query_id", *by, F.size("words").alias("terms"), F.explode("words").alias("term"))
        df = self._read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        return asked.join(df, "term").select("query_id", *by, "term", (idf * (K1 + 1)).alias("weight"), "df", "terms")

    def _scored(self, asked: DataFrame, pairs: DataFrame, mean: float) -> DataFrame:
        """(query_id, id, bm25, found) of pairs (query_id, id): their whole scores.

        Candidates go to the chunks they are in, so postings of the asked terms are filtered
        before they are unpacked.
        """
        sizes = F.array(*(F.lit(c).cast("long") for c in sorted({r["chunks"] for r in self._runs()})))
        places = pairs.select("id").distinct().select("id", F.explode(sizes).alias("chunks"))
        places = places.groupBy("chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk")).agg(F.collect_list("id").alias("ids"))
        packed = self._read("postings", POSTINGS).join(asked.select("term").distinct(), "term", "left_semi").join(places, ["chunks", "chunk"])
        packed = packed.where(F.arrays_overlap(F.transform("posts", lambda p: p["id"]), "ids"))
        found = self._posts(packed.select("term", "run", "posts"))
        part = F.col("weight") * _impact(F.col("tf"), F.col("len"), F.lit(mean))
        # a row for each candidate and term of its query, not for each term of the candidate
        each = pairs.join(asked, "query_id").join(found, ["id", "term"])
        return each.groupBy("query_id", "id").agg(F.sum(part).alias("bm25"), F.count("*").alias("found"), F.first("terms").alias("terms"))

    def _levels(self, asked: DataFrame, mean: float) -> DataFrame:
        """(query_id, term, weight, tier, n, top): the most that a posting of a tier adds, whatever the mean is by now."""
        ratio = F.least(F.lit(1.0), F.col("mean") / F.lit(mean))
        bound = F.col("peak") / (F.col("peak") + ratio * (1 - F.col("peak")))
        tiers = self._read("postings", POSTINGS).join(asked.select("term").distinct(), "term", "left_semi")
        tiers = tiers.groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max(bound).alias("bound"), F.max("chunks").alias("chunks"))
        return asked.join(tiers, "term").select("query_id", "term", "weight", "df", "terms", "tier", "n", "chunks", (F.col("weight") * F.col("bound")).alias("top"))

    def _partial(self, chosen: DataFrame, part: Column, within: Callable[[DataFrame], DataFrame], mean: float, chunk: Column | None = None) -> DataFrame:
        """(query_id, id, partial) over the postings of chosen (query_id, term, tier, ..)."""
        met = self._read("postings", POSTINGS).drop("n", "chunks").join(chosen, ["term", "tier"])
        found = within(self._posts(met if chunk is None else met.where(chunk)))
        return found.groupBy("query_id", "id").agg(F.sum(part).alias("partial"), F.sum(F.col("weight") * _impact(F.col("tf"), F.col("len"), F.lit(mean))).alias("sure"))

    def _candidates(self, asked: DataFrame, limit: int, within: Callable[[DataFrame], DataFrame], mean: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """((query_id, id, sure) that can be among the best, (query_id, term, tier, weight) that was skipped, (query_id, postings, read))."""
        levels = written(self._levels(asked, mean), "index-levels")
        part = F.col("weight") * _impact(F.col("tf"), F.col("len"), F.lit(mean))
        # a first estimate: the whole scores of a few rows from the tiers that promise most
        best = Window.partitionBy("query_id").orderBy(F.col("top").desc(), "term", "tier")
        before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = levels.withColumn("before", before).where(F.col("before") < SEED_POSTINGS)
        some = F.col("chunk") < F.greatest(F.lit(1), F.ceil(F.col("chunks") * SEED_POSTINGS / F.col("n")))
        seeds = self._partial(seeds.select("query_id", "term", "tier", "weight", "n", "chunks"), part, within, mean, some)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("partial").desc(), "id"))
        seeds = written(seeds.withColumn("rank", rank).where(F.col("rank") <= SEED_ROWS * limit).select("query_id", "id"), "index-seeds")
        by_score = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc()))
        least = self._scored(asked, seeds, mean).withColumn("rank", by_score).where(F.col("rank") == limit).select("query_id", (F.col("bm25") * (1 - 1e-9) - 1e-9).alias("least"))
        # tiers below a query's level are skipped: with all terms cut off at it, no row reaches the estimate
        terms = levels.groupBy("query_id", "term").agg(F.max("top").alias("top")).join(least, "query_id", "left")
        rising = Window.partitionBy("query_id").orderBy("top", "term")
        cut = (F.coalesce("least", F.lit(0.0)) - F.coalesce(F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / (
            F.count("*").over(Window.partitionBy("query_id")) - F.row_number().over(rising) + 1
        )
        level = terms.select("query_id", "least", cut.alias("cut")).groupBy("query_id").agg(F.max("cut").alias("level"), F.first("least").alias("least"))
        judged = levels.join(level, "query_id").withColumn("skipped", F.when(F.col("top") < F.col("level"), F.col("top")).otherwise(0.0))
        of_term = judged.groupBy("query_id", "term").agg(F.max("skipped").alias("skip"))
        unseen = of_term.groupBy("query_id").agg(F.sum("skip").alias("unseen"))
        read = judged.where("skipped = 0").select("query_id", "term", "tier", "weight").join(of_term, ["query_id", "term"])
        found = self._partial(read, part - F.col("skip"), within, mean).join(level.select("query_id", "least"), "query_id").join(unseen, "query_id")
        found = found.where(F.col("least").isNull() | (F.col("partial") + F.col("unseen") >= F.col("least"))).select("query_id", "id", "sure")
        cost = judged.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("skipped") == 0, F.col("n")).otherwise(0)).alias("read"))
        rest = judged.where("skipped > 0").select("query_id", "term", "tier", "weight")
        return written(found, "index-candidates"), rest, cost

    def search(self, queries: DataFrame, limit: int = 10, match: str = "any", among: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, id, bm25, rank) of the ``limit`` best rows for each of queries (query_id, text), exact.

        match: ``any`` ranks rows with at least one term, ``all`` rows with every term (a term that no
        row has leaves nothing). Only rows ``among`` (id) count, where given, and for each query
        those that are equal to it in the columns ``by`` of both; frequencies and the mean length span all. Terms are words without case and marks, each once. Equal to nine places, rows go by id.
        """
        n, length = self._sizes()
        mean = max(length, 1) / max(n, 1)
        asked = written(self.weights(queries, by), "index-asked")
        within = _within(asked, among, by)
        if match == "all":
            rarest = asked.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).where("nth = 1")
            packed = self._read("postings", POSTINGS).join(rarest.select("query_id", "term"), "term")
            pairs = self._posts(packed.select("query_id", "run", "posts")).select("query_id", "id")
            scored = self._scored(asked, written(within(pairs), "index-candidates"), mean)
        elif (asked.agg(F.sum("df")).first()[0] or 0) <= DIRECT_POSTINGS:
            packed = self._read("postings", POSTINGS).join(asked, "term").select("query_id", "weight", "run", "posts")
            part = F.col("weight") * _impact(F.col("tf"), F.col("len"), F.lit(mean))
            scored = within(self._posts(packed)).groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
        else:
            pairs, rest, _ = self._candidates(asked, limit, within, mean)
            # what the candidates have in the tiers that were skipped
            tiers = rest.select("term", "tier").distinct()
            posts = self._posts(self._read("postings", POSTINGS).join(tiers, ["term", "tier"], "left_semi").select("term", "tier", "run", "posts"))
            wanted = pairs.select("query_id", "id").join(rest.groupBy("query_id", "term").agg(F.collect_set("tier").alias("tiers"), F.first("weight").alias("weight")), "query_id")
            part = F.col("weight") * _impact(F.col("tf"), F.col("len"), F.lit(mean))
            more = wanted.join(posts, ["id", "term"]).where(F.array_contains("tiers", F.col("tier"))).groupBy("query_id", "id").agg(F.sum(part).alias("more"))
            scored = pairs.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("sure") + F.coalesce("more", F.lit(0.0))).alias("bm25"))
        scored = scored.where("found = terms") if match == "all" else scored
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id", "bm25", "rank")

    def cost(self, queries: DataFrame, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
        """(query_id, postings, read, scored): postings of each query's terms, those a search reads, rows it scores."""
        n, length = self._sizes()
        asked = written(self.weights(queries), "index-asked")
        pairs, _, cost = self._candidates(asked, limit, _within(asked, among, ()), max(length, 1) / max(n, 1))
        return cost.join(pairs.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id", "left")
