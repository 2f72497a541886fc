"""The vector index and the BM25 blocks against plain scans."""

import math
import random
from collections import Counter

import numpy as np

from ledgerloom import registry
from ledgerloom.functions import kernels
from ledgerloom.functions.kernels import cosine_top_k
from ledgerloom.operators import retrieval, vector_index
from ledgerloom.operators.retrieval import Asked, Top, score_cell

ROWS, QUERIES = "id long, embedding array<float>", "query_id long, embedding array<float>"


def frames(spark, m, q):
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(90_000, None), (90_001, [])]
    return spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(q)), (800, None)], QUERIES)


def hits(df):
    return {(r.query_id, r["rank"]): r.id for r in df.collect()}


def brute(m, q, k):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit(q) @ unit(m).T
    return {(i, n + 1): int(j) for i, row in enumerate(score) for n, j in enumerate(sorted(range(len(m)), key=lambda j: (-round(row[j], 9), j))[:k])}


def test_grouped_vectors_need_few_lists(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16)) * 6
    m = (centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16))).astype("float32")
    rows, queries = frames(spark, m, m[::100] + 0.01)
    index = vector_index.build_index(rows, 40, k=10)
    assert sum(index.sizes) == 3000 and index.recall >= 0.95 and index.probes <= 6
    truth = vector_index.search_index(index, queries, 10, exact=True)
    assert hits(truth) == brute(m, m[::100] + 0.01, 10) == hits(cosine_top_k(rows, queries, 10))
    assert vector_index.recall(vector_index.search_index(index, queries, 10), truth) >= 0.9
    assert vector_index.rows_met(index, queries) < 0.25 * 3000 * 30
    met = [vector_index.rows_met(vector_index.build_index(rows, n, k=10), queries, 1) for n in (4, 16, 40)]
    assert met == sorted(met, reverse=True)


def test_one_list_that_holds_most_rows_is_dealt_in_cells(spark, monkeypatch):
    r = np.random.default_rng(2)
    m = np.concatenate([np.ones((900, 8)) + 0.05 * r.normal(size=(900, 8)), r.normal(size=(100, 8))]).astype("float32")
    rows, queries = frames(spark, m, m[:60])
    monkeypatch.setattr(vector_index, "CELL", 50)
    index = vector_index.build_index(rows, 6)
    assert hits(vector_index.search_index(index, queries, 7, probes=6)) == brute(m, m[:60], 7)


def test_tables_without_vectors(spark):
    rows, queries = frames(spark, np.zeros((0, 4)), np.zeros((0, 4)))
    assert vector_index.search_index(vector_index.build_index(rows), queries).count() == 0 == cosine_top_k(rows, queries, 3).count()


def test_ties_and_batches_keep_the_first_ids(spark):
    m = np.tile(np.eye(4, dtype="float32"), (500, 1))
    rows, queries = frames(spark, m, np.eye(4, dtype="float32"))
    assert hits(cosine_top_k(rows, queries, 3)) == {(q, n + 1): q + 4 * n for q in range(4) for n in range(3)}


def plain_bm25(chunks, queries, k):
    token = {i: Counter(t.split()) for i, t in chunks.items()}
    size = {i: sum(c.values()) for i, c in token.items()}
    mean, df = sum(size.values()) / len(chunks), Counter(w for c in token.values() for w in c)
    raw = {w: math.log(len(chunks) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else floor for w, x in raw.items()}
    out = {}
    for q, t in queries.items():
        ask = Counter(t.split())
        score = {i: round(sum(n * idf[w] * token[i][w] * 2.5 / (token[i][w] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for w, n in ask.items() if token[i][w]), 6) for i in chunks if any(token[i][w] for w in ask)}
        own = sorted(score, key=lambda i: (-score[i], i))[:k]
        own += [i for i in sorted(chunks) if i not in own][: k - len(own)]
        out |= {(q, n + 1): i for n, i in enumerate(own)}
    return out


def test_blocks_give_the_same_lists_as_a_scan(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    chunks = {i * 7: " ".join(r.choices(words, [1 / (n + 1) for n in range(300)], k=r.randint(0, 60))) for i in range(700)}
    queries = {i: " ".join(r.choices(words, k=r.randint(1, 8))) for i in range(40)} | {50: "none of these", 51: ""}
    monkeypatch.setattr(retrieval, "CELL", 16)
    frame = spark.createDataFrame(list(chunks.items()), "id long, content string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    index = retrieval.bm25_index(frame)
    for block in (200_000, 20):
        assert hits(retrieval.bm25_search(index, asked, frame, 5, block)) == plain_bm25(chunks, queries, 5)


def test_cells_below_the_kth_score_are_not_met():
    block = lambda ids, tf: {"token": "t", "top_tf": tf, "least_length": 10, "ids": np.array(ids), "tfs": np.full(len(ids), tf), "lengths": np.full(len(ids), 10)}
    asked = Asked(np.array([5]), {"t": np.array([0])}, {"t": np.array([1.0])})
    top = Top(2, 1)
    score_cell([block([1, 2, 3], 9)], asked, 10.0, top)
    assert top.met[0] == 3
    score_cell([block(range(100, 200), 1)], asked, 10.0, top)
    assert top.met[0] == 3
    score_cell([block([7], 12)], asked, 10.0, top)
    assert top.met[0] == 4 and top.best.all()[1].tolist() == [7, 1]


def test_a_token_in_every_chunk_and_an_empty_corpus(spark):
    frame = spark.createDataFrame([(i, f"all x{i % 7}") for i in range(400)], "id long, content string")
    asked = spark.createDataFrame([(1, "all"), (2, "all x3")], "query_id long, text string")
    got = hits(retrieval.bm25_search(retrieval.bm25_index(frame), asked, frame, 3))
    assert [got[2, n] for n in (1, 2, 3)] == [3, 10, 17]
    empty = frame.where("false")
    assert retrieval.bm25_search(retrieval.bm25_index(empty), asked, empty, 3).count() == 0


def test_a_query_is_sent_once_to_each_bundle_of_lists(spark, monkeypatch):
    r = np.random.default_rng(5)
    m = r.normal(size=(700, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    asked = frame.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build_index(frame, 30, k=10)
    assert vector_index.probed(index, asked, 30).count() == 100  # a row for each query, not for each list
    truth = hits(cosine_top_k(frame, asked, 10))
    for cell, queries, scores in ((20_000, 4096, 1 << 20), (50, 9, 64)):  # several bundles, parts and slices give the same
        monkeypatch.setattr(vector_index, "CELL", cell)
        monkeypatch.setattr(vector_index, "QUERIES", queries)
        monkeypatch.setattr(vector_index, "CELLS", scores)
        assert hits(vector_index.search_index(index, asked, 10, 30)) == truth


def test_rows_are_dealt_by_the_pairs_that_they_make(spark, monkeypatch):
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0 + i % 5]) for i in range(200)], "id long, embedding array<float>").coalesce(1)
    asked = frame.limit(30).withColumnRenamed("id", "query_id")
    whole = hits(cosine_top_k(frame, asked, 4))
    monkeypatch.setattr(kernels, "TASK_SCORES", 1000)
    assert kernels.cosine_hits(frame, asked, 4).rdd.getNumPartitions() == 6 and hits(cosine_top_k(frame, asked, 4)) == whole


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"w{i % 13} w{i % 5} common") for i in range(300)], "id long, content string")
    asked = spark.createDataFrame([(q, f"w{q} common") for q in range(5)], "query_id long, text string")
    whole = hits(retrieval.bm25_search(retrieval.bm25_index(frame), asked, frame, 7))
    monkeypatch.setattr(retrieval, "CELL", 5)
    monkeypatch.setattr(retrieval, "TEXT_BYTES", 200)
    index = retrieval.bm25_index(frame)
    assert len(index.blocks.inputFiles()) > 8  # more than the session's shuffle partitions
    assert hits(retrieval.bm25_search(index, asked, frame, 7)) == whole


def test_one_index_for_a_context_and_its_audit(spark, monkeypatch):
    made, build = [], retrieval.bm25_index
    monkeypatch.setattr(retrieval, "bm25_index", lambda *a: made.append(1) or build(*a))
    assert registry.queries()["audit_context_clean"](spark, "/root/testdata/sf0.001").where("lost > 0").count() == 0 and len(made) == 1


def test_vectors_beside_the_texts(spark):
    frame = spark.createDataFrame([(i, f"w{i % 4} w{i % 3}", [float(i), 3.0] if i % 5 else None) for i in range(60)], "id long, content string, embedding array<float>")
    asked = spark.createDataFrame([(q, f"w{q}", [1.0, float(q)]) for q in range(4)], "query_id long, text string, embedding array<float>")
    got = retrieval.hybrid_retrieve(frame.select("id", "content"), asked, vectors=frame.select("id", "embedding"))
    assert sorted(got.collect()) == sorted(retrieval.hybrid_retrieve(frame, asked).collect())
