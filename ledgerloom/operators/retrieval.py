"""Batched hybrid retrieval: BM25, cosine, reciprocal rank fusion, parents and contexts."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kernels import CELLS, RunningBest, best_of, cosine_top_k
from ..functions.scratch import cut
from .documents import UNTITLED
from .vector_index import VectorIndex, search_index

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a cell, and bytes of text and cells that a task takes, about.
CELL, TEXT_BYTES, TASK_CELLS = 512, 4 << 20, 8
_CJK = "[\\x{4e00}-\\x{9fff}]"


def tokenize(text: Column) -> Column:
    """CJK runs give all bigrams, then all characters; other runs give lower-case words of letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(f"({_CJK}+|[a-zA-Z0-9]+)"))

    def split(run: Column) -> Column:
        pairs = F.when(F.length(run) >= 2, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(run.rlike(f"^{_CJK}"), F.concat(pairs, F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1))))).otherwise(F.array(F.lower(run)))

    small = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(small, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(text.rlike(_CJK), F.flatten(F.transform(runs, split))).otherwise(words)  # most texts need no second look at a run


@dataclass(frozen=True)
class Bm25Index:
    """Postings in blocks, weights (token, df, idf), and how many chunks there are and how long they are on average.

    A block (token, cell, top_tf, least_length, ids, tfs, lengths) holds a token's postings, by id, among the chunks of a cell, about
    512 chunks by the hash of their ids. Its most frequent count and its shortest chunk bound what any of its postings gives,
    whatever the average length, so blocks outlive changes of the corpus around them.
    """

    blocks: DataFrame
    weights: DataFrame
    n: int
    average: float


def bm25_index(chunks: DataFrame, text: str = "content") -> Bm25Index:
    """Index of chunks (id, text), written once, in each file by token; null texts have no tokens but count as chunks."""
    n, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    cell = F.pmod(F.xxhash64("id"), F.lit(n // CELL + 1)).cast("int")

    # texts are dealt by cell once, over tasks by their size; terms are counted and gathered where they lie, so postings are not shuffled
    dealt = chunks.select(F.col("id").cast("long").alias("id"), cell.alias("cell"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(size // TEXT_BYTES + 1, "cell")
    tokens = dealt.select("cell", "id", tokenize(F.col("text")).alias("t")).select("cell", "id", F.size("t").alias("length"), F.explode("t").alias("token"))
    postings = tokens.groupBy("token", "cell", "id", "length").agg(F.count("*").cast("int").alias("tf"))
    blocks = postings.groupBy("token", "cell").agg(F.max("tf").alias("top_tf"), F.min("length").alias("least_length"), F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("p"))
    blocks = cut(blocks.select("token", "cell", "top_tf", "least_length", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths")).sortWithinPartitions("token", "cell"))
    size = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    df = cut(blocks.groupBy("token").agg(F.sum(F.size("ids")).alias("df"), F.sum(size).alias("times")))
    total = df.agg(F.sum("times")).first()[0] or 0
    raw = df.select("token", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
    return Bm25Index(blocks, raw.select("token", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")), n, total / n if n else 1.0)


class Asked(NamedTuple):
    """Queries as the tasks hold them: ids, and for each token the queries that ask for it and its weight in them."""

    ids: np.ndarray
    queries: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]

    @staticmethod
    def of(terms: list) -> Asked:
        ids = np.unique(np.array([t.query_id for t in terms], np.int64))
        queries: dict[str, list] = {}
        for t in terms:
            queries.setdefault(t.token, []).append((np.searchsorted(ids, t.query_id), t.weight))
        return Asked(ids, {w: np.array([q for q, _ in x]) for w, x in queries.items()}, {w: np.array([v for _, v in x]) for w, x in queries.items()})


class Top:
    """What a task knows of the best hits of each query."""

    def __init__(self, k: int, queries: int):
        self.best, self.scores, self.met = RunningBest(k, queries), np.full((queries, k), -np.inf), np.zeros(queries, np.int64)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Hits by query, each query's in falling order, k of each at most."""
        self.best.add(query, ids, score)
        some, first = np.unique(query, return_index=True)
        new = np.full((len(some), self.scores.shape[1]), -np.inf)
        at = np.searchsorted(some, query)
        new[at, np.arange(len(query)) - first[at]] = score
        self.scores[some] = -np.sort(-np.concatenate([self.scores[some], new], 1), 1)[:, : new.shape[1]]


def score_cell(blocks: list[dict], asked: Asked, average: float, top: Top) -> None:
    """Adds the best hits of a cell; queries that its blocks cannot lift to their k-th score so far do not meet its postings."""
    most = np.zeros(len(asked.ids))
    for b in blocks:
        bound = b["top_tf"] / (b["top_tf"] + K1 * (1 - B + B * b["least_length"] / average))
        most[asked.queries[b["token"]]] += np.maximum(asked.weights[b["token"]], 0) * bound
    asking = np.zeros(len(asked.ids), bool)
    for b in blocks:
        asking[asked.queries[b["token"]]] = True
    live = np.flatnonzero(asking & (most >= top.kth() - 1e-5))
    if not len(live):
        return
    ids = np.unique(np.concatenate([b["ids"] for b in blocks]))
    place = np.full(len(asked.ids), -1)
    each = max(1, CELLS // len(ids))
    for i in range(0, len(live), each):
        own = live[i : i + each]
        place[:] = -1
        place[own] = np.arange(len(own))
        score, hit = np.zeros((len(own), len(ids))), np.zeros((len(own), len(ids)), bool)
        for b in blocks:
            queries = place[asked.queries[b["token"]]]
            here = queries >= 0
            if here.any():
                at = np.ix_(queries[here], np.searchsorted(ids, b["ids"]))
                score[at] += asked.weights[b["token"]][here, None] * (b["tfs"] / (b["tfs"] + K1 * (1 - B + B * b["lengths"] / average)))
                hit[at] = True
                top.met[own[queries[here]]] += len(b["ids"])
        score = np.round(score, 6)
        line, column = best_of(np.where(hit, score, -np.inf), ids, top.best.k)
        top.add(own[line], ids[column], score[line, column])


def bm25_search(index: Bm25Index, queries: DataFrame, ids: DataFrame, k: int = 20, block: int = 200_000) -> DataFrame:
    """(query_id, id, score, rank): query tokens count as often as they occur; lists are filled up in id order with score 0.

    queries (query_id, text), ids: all chunk ids. Blocks of the tokens that are asked for meet by cell, each cell in one task, and
    a query skips the cells whose blocks' bounds together stay below its k-th score among those met in the task. Queries are
    sent to the tasks in blocks of about ``block`` terms.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    terms = cut(asked.join(index.weights, "token").select("query_id", "token", (F.col("times") * F.col("idf") * (K1 + 1)).alias("weight")))
    rounds = max(1, -(-terms.count() // block))
    average, spark, out = index.average or 1.0, queries.sparkSession, None
    for r in range(rounds):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) if rounds > 1 else terms
        shared = spark.sparkContext.broadcast(Asked.of(own.collect()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, held, cell = shared.value, [], None
            best = Top(k, len(asked.ids))
            for batch in batches:
                arrays = {c: (batch[c].offsets.to_numpy(), batch[c].flatten().to_numpy()) for c in ("ids", "tfs", "lengths")}
                for i, (token, at, top, least) in enumerate(zip(*(batch[c].to_pylist() for c in ("token", "cell", "top_tf", "least_length")))):
                    if at != cell and held:
                        score_cell(held, asked, average, best)
                        held = []
                    cell = at
                    first = arrays["ids"][0][0]
                    held.append({"token": token, "top_tf": top, "least_length": least} | {c: x[o[i] - first : o[i + 1] - first] for c, (o, x) in arrays.items()})
            if held:
                score_cell(held, asked, average, best)
            query, found, score = best.best.all()
            yield pa.record_batch({"query_id": pa.array(asked.ids[query], pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

        wanted = index.blocks.join(own.select("token").distinct(), "token", "left_semi").repartition(index.n // (CELL * TASK_CELLS) + 1, "cell").sortWithinPartitions("cell")
        part = wanted.mapInArrow(search, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = cut(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    short = queries.select("query_id").join(top.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").na.fill(0, ["have"]).where(F.col("have") < k)
    lowest = ids.select("id").orderBy("id").limit(k)  # k rows: as many unmatched ids as any query can lack
    fill = short.crossJoin(F.broadcast(lowest)).join(top.select("query_id", "id"), ["query_id", "id"], "left_anti")
    fill = fill.withColumn("rank", F.col("have") + F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= k)
    return top.select("query_id", "id", "score", "rank").unionByName(fill.select("query_id", "id", F.lit(0.0).alias("score"), F.col("rank").cast("int").alias("rank")))


def nearest(chunks: DataFrame | VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): from an index, or exactly over all rows."""
    return search_index(chunks, queries, k) if isinstance(chunks, VectorIndex) else cosine_top_k(chunks, queries, k)


def vector_search(chunks: DataFrame | VectorIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank) by cosine; the score 1 - distance / 2 is rounded to four places. Null vectors take no part."""
    return nearest(chunks, queries, k).select("query_id", "id", F.round(0.5 + F.col("similarity") / 2, 4).alias("score"), "rank")


def rrf(keyword: DataFrame, vector: DataFrame, ids: DataFrame | None = None, k: int = 60, top_k: int = 5) -> DataFrame:
    """Reciprocal rank fusion; vector hits outside the keyword corpus ``ids`` are dropped; ties keep the keyword list's order."""
    vector = vector.join(ids.select("id"), "id", "left_semi") if ids is not None else vector
    vector = vector.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))) if ids is not None else vector
    both = keyword.select("query_id", "id", F.col("rank").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(vector.select("query_id", "id", F.lit(None).cast("int").alias("a"), F.col("rank").alias("b")))
    sums = both.groupBy("query_id", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    fused = sums.withColumn("raw", F.coalesce(1.0 / (k + F.col("a")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("b")), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), F.asc_nulls_last("a"), F.asc_nulls_last("b"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "id", F.round("raw", 4).alias("score"), "rank")


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = 5, list_k: int = 20, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """chunks (id, content, embedding), queries (query_id, text, embedding); without a vector a row is found by its words alone.

    vectors: an index of the chunks' vectors, or a table (id, embedding) of them, so that texts need not be joined; either is
    otherwise taken from the chunks, which are all met.
    """
    keyword = bm25_search(bm25_index(chunks), queries, chunks, list_k)
    return rrf(keyword, vector_search(chunks if vectors is None else vectors, queries, list_k), chunks, top_k=top_k)


def parent_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks under the parents of hits (which carry file_name and parent_key), in index order; empty parents do not count."""
    keys = hits.where("parent_key <> ''").select("file_name", "parent_key").distinct()
    return chunks.join(keys, ["file_name", "parent_key"], "left_semi").orderBy("file_name", "parent_key", "chunk_index")


def build_context(hits: DataFrame, chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """(query_id, context): hits by chapter in first-hit order, each with a source number, with the chapter's other chunks.

    hits (query_id, rank, id), chunks (id, file_name, parent_key, chunk_index, chapter, section, content). Of a chapter
    longer than ``limit`` only its preamble and the neighbours of hits are added; hits without a parent come last.
    """
    found = hits.select("query_id", "rank", "id").join(chunks, "id")
    wanted = cut(found.where("parent_key <> ''").groupBy("query_id", "file_name", "parent_key").agg(F.min("rank").alias("first")))  # few beside the chunks
    rows = wanted.join(chunks.where("parent_key <> ''"), ["file_name", "parent_key"]).join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    group = Window.partitionBy("query_id", "file_name", "parent_key")
    near = group.orderBy("chunk_index", "id")
    hit = F.col("rank").isNotNull()
    rows = rows.withColumns({"size": F.sum(F.length("content")).over(group), "beside": F.coalesce(F.lag(hit).over(near), F.lit(False)) | F.coalesce(F.lead(hit).over(near), F.lit(False))})
    rows = rows.where(hit | (F.col("size") <= limit) | F.col("beside") | (F.col("section") == ""))
    strip = lambda c: F.trim(F.regexp_replace(c, r"\A## [^\n]*\n+", ""))
    mark = F.when(hit, F.concat(F.lit("[来源"), F.col("rank"), F.lit("] "))).otherwise(F.lit("[上下文] "))
    lines = rows.groupBy("query_id", "first", "file_name", "parent_key", "chapter").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.concat(mark, strip(F.col("content"))).alias("t")))).alias("l"))
    block = F.concat(F.lit("## "), F.col("chapter"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    blocks = lines.select("query_id", F.struct(F.lit(0).alias("loose"), F.col("first").alias("at"), F.col("file_name"), block.alias("t")).alias("b"))
    loose = found.where("coalesce(parent_key, '') = ''").select("query_id", F.struct(F.lit(1).alias("loose"), F.col("rank").alias("at"), F.col("file_name"), F.concat(F.lit("[来源"), F.col("rank"), F.lit("] "), F.col("content")).alias("t")).alias("b"))
    return blocks.unionByName(loose).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "\n---\n").alias("context"))


def audit_context(contexts: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each query: how many of its hits' texts the context does not hold exactly once, and the context's length."""
    body = F.trim(F.regexp_replace("content", r"\A## [^\n]*\n+", ""))
    held = hits.select("query_id", "id", "rank").join(chunks.select("id", "content"), "id").select("query_id", "rank", body.alias("body")).join(contexts, "query_id")
    once = F.size(F.split("context", F.concat(F.lit("\\[来源"), F.col("rank"), F.lit("\\]")), -1)) == 2
    return held.groupBy("query_id").agg(F.count_if(~(once & F.contains("context", "body"))).alias("lost"), F.max(F.length("context")).alias("length"))


def extract_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks, "id").select("query_id", "rank", "score", F.coalesce(F.nullif("doc_title", F.lit("")), F.lit(UNTITLED)).alias("doc_title"), "file_name", "chapter", "section", "content")


def calibrate_floor(on: DataFrame, off: DataFrame, chunks: DataFrame | VectorIndex, floors: list[float]) -> DataFrame:
    """For each floor: on-topic queries lost and off-topic ones blocked by it, with the extremes of both best scores."""
    best = lambda q, topic: vector_search(chunks, q, 1).select(F.lit(topic).alias("topic"), "score")
    scores = best(on, "on").unionByName(best(off, "off"))
    sums = scores.agg(
        F.min(F.when(F.col("topic") == "on", F.col("score"))).alias("min_on"), F.max(F.when(F.col("topic") == "off", F.col("score"))).alias("max_off"),
        F.median(F.when(F.col("topic") == "on", F.col("score"))).alias("median_on"), F.median(F.when(F.col("topic") == "off", F.col("score"))).alias("median_off"),
        F.array(*(F.struct(F.lit(f).alias("floor"), F.count_if((F.col("topic") == "on") & (F.col("score") < f)).alias("lost"), F.count_if((F.col("topic") == "off") & (F.col("score") < f)).alias("blocked")) for f in floors)).alias("x"),
    )
    return sums.select("min_on", "max_off", "median_on", "median_off", F.round(F.col("min_on") - F.col("max_off"), 4).alias("gap"), F.explode("x").alias("x")).select("*", "x.*").drop("x")
