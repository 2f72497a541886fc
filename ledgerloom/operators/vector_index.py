"""An inverted-list index of vectors: lists around centroids, every row in one list, scores computed exactly within the lists probed.

Centroids are fitted on a bounded sample; every row is indexed. How many lists a query probes is measured on the same sample: as
few as keep the wanted share of true neighbours. Well grouped vectors need a few lists, vectors without any structure need most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import CELLS, RunningBest, best_of, cosine_top_k, has_vector, ranked_hits, unit_rows
from ..functions.scratch import scratch

#: Bounds of the sample, and of the lists, whose centroids and sizes the driver and every task hold.
SAMPLE_ROWS, SAMPLE_BYTES, LISTS = 20_000, 64 << 20, 4096
#: Rows and queries that meet in one task at once; a larger list is dealt over several.
CELL, QUERIES = 20_000, 4096


@dataclass(frozen=True)
class VectorIndex:
    """rows (list, id, embedding) in the order of their lists; sizes: rows of each list; recall: measured with that many probes."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: tuple[int, ...]
    probes: int
    recall: float


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means; a list that loses all its rows takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        score = sample @ centroids.T
        own = score.argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        total[lost] = sample[np.argsort(score.max(1))[: len(lost)]]
        centroids = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)
    return centroids


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, asked: int = 256) -> tuple[int, float]:
    """How many lists keep ``target`` of the k nearest rows of the sample, and the share that they keep."""
    queries = sample[np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)]
    score = queries @ sample.T
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample))]
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(place, (sample @ centroids.T).argmax(1)[near], 1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=len(centroids))) / needed.size
    probes = int(np.searchsorted(share, target - 1e-12)) + 1
    return min(probes, len(centroids)), float(share[min(probes, len(centroids)) - 1])


def build_index(rows: DataFrame, lists: int | None = None, target: float = 0.95, k: int = 20, seed: int = 7) -> VectorIndex:
    """Index of rows (id, embedding), written to the shared folder in the order of lists, so that a search reads those it probes.

    lists: about the square root of the number of rows by default. The sample is the rows of the smallest id hashes, at most
    20,000 and 64 MB. Rows without a vector are not indexed.
    """
    spark = rows.sparkSession
    rows = rows.where(has_vector()).select("id", "embedding")
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * size)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toPandas()
    sample = unit_rows(sample["embedding"]) if len(sample) else np.zeros((1, 1))
    lists = max(1, min(lists or int(n**0.5), LISTS, len(sample)))
    centroids = fit_centroids(sample, lists, seed=seed)
    probes, recall = probes_needed(sample, centroids, k, target)
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def list_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0, "int32"), *((unit_rows(v) @ shared.value.T).argmax(1) for v in _slices(vectors, len(shared.value)))]).astype("int32"))

    path = scratch(spark)
    rows.withColumn("list", list_of("embedding")).repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(path)
    stored = spark.read.parquet(path)
    counts = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # as many rows as lists
    return VectorIndex(stored, centroids, tuple(counts.get(c, 0) for c in range(lists)), probes, recall)


def _slices(rows: pd.Series | pd.DataFrame, width: int) -> Iterator[pd.Series | pd.DataFrame]:
    """Rows as many at a time as may meet ``width`` others at once."""
    each = max(1, CELLS // width)
    return (rows.iloc[i : i + each] for i in range(0, len(rows), each))


def probed(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, embedding, lists): the nearest lists of each query that has a vector."""
    shared, n = queries.sparkSession.sparkContext.broadcast(index.centroids), probes or index.probes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked in _slices(batch, len(shared.value)):
                near = np.argsort(-(unit_rows(asked["embedding"]) @ shared.value.T), axis=1)[:, :n].astype("int32")
                yield pd.DataFrame({"query_id": asked["query_id"], "embedding": asked["embedding"], "lists": pd.Series(list(near), index=asked.index)})

    return queries.where(has_vector()).select("query_id", "embedding").mapInPandas(run, "query_id long, embedding array<float>, lists array<int>")


def search_index(index: VectorIndex, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of largest cosine among the lists that each query probes, ties by id.

    ``exact`` meets every row instead. Neighbouring lists are bundled up to about 20,000 rows, and a query is sent once to each bundle in
    which it probes lists; bundles and their queries are dealt in cells of about 20,000 rows and 4,096 queries, whatever the size of
    the largest list. Only lists that some query probes are read.
    """
    if exact:
        return cosine_top_k(index.rows, queries, k)
    bundles = (np.concatenate([[0], np.cumsum(index.sizes)[:-1]]) // CELL).astype(int)
    of = F.array(*(F.lit(int(b)) for b in bundles))
    asked = probed(index, queries, probes).withColumn("bundle", F.explode(F.array_distinct(F.transform("lists", lambda c: of[c]))))
    asked = asked.withColumn("lists", F.filter("lists", lambda c: of[c] == F.col("bundle"))).cache()
    per = asked.groupBy("bundle").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("lists"))).alias("lists")).collect()  # as many rows as bundles
    if not per:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    per_bundle, wanted = {r.bundle: r.n for r in per}, sorted({c for r in per for c in r.lists})
    parts = lambda sizes, most: F.array(*(F.lit(max(1, -(-int(n) // most))) for n in sizes))
    row_parts = parts(np.bincount(bundles, index.sizes), CELL)
    query_parts = parts([per_bundle.get(b, 0) for b in range(bundles[-1] + 1)], QUERIES)
    mine, other = (lambda column, every: F.pmod(F.xxhash64(column), every[F.col("bundle")]).cast("int")), (lambda every: F.explode(F.sequence(F.lit(0), every[F.col("bundle")] - 1)))
    rows = index.rows.where(F.col("list").isin(wanted)).withColumn("bundle", of[F.col("list")]).withColumn("a", mine("id", row_parts)).withColumn("b", other(query_parts))
    asked = asked.withColumn("b", mine("query_id", query_parts)).withColumn("a", other(row_parts))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        kept = RunningBest(k, len(asked))
        if len(rows) and len(asked):
            q, ids = unit_rows(asked["embedding"]), rows["id"].to_numpy()
            probing = pd.DataFrame({"list": np.concatenate(asked["lists"].to_list()), "at": np.repeat(np.arange(len(asked)), asked["lists"].map(len))}).groupby("list")["at"]
            probing = {c: x.to_numpy() for c, x in probing}
            for c, at in rows.groupby("list").indices.items():
                m, asking = unit_rows(rows["embedding"].iloc[at]).T, probing.get(c, ())
                each = max(1, CELLS // len(at))
                for i in range(0, len(asking), each):
                    score = q[asking[i : i + each]] @ m
                    line, place = best_of(score, ids[at], k)
                    kept.add(asking[i + line], ids[at][place], score[line, place])
        query, found, score = kept.all()
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[query], "id": found, "similarity": score})

    hits = rows.groupBy("bundle", "a", "b").cogroup(asked.groupBy("bundle", "a", "b")).applyInPandas(meet, "query_id long, id long, similarity double")
    return ranked_hits(hits, k)


def rows_met(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> int:
    """How many pairs of a row and a query a search scores."""
    by_list = probed(index, queries, probes).select(F.explode("lists").alias("list")).groupBy("list").count().collect()
    return sum(index.sizes[r["list"]] * r["count"] for r in by_list)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true hits (query_id, id) that were found."""
    n = truth.count()
    return truth.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0
