"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each token slot has a sparse random index vector. A slot's word vector is the sum of the index
vectors of its neighbours over the whole corpus: tasks sum their own, then sums of sums are made in
two rounds, so no task meets more than a few hundred blocks at a scale of many thousands of tasks.
A document is the mean of its tokens' word and index vectors. The network is fitted in numpy on a
bounded sample of labelled rows, and its probabilities are calibrated by a temperature on rows kept
out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text, runs, text_buffer, word_hashes

#: Slots of the token table and length of a vector: the table of sums has 8 bytes x SLOTS x DIM, whatever the corpus.
SLOTS, DIM, NONZERO, REACH = 1 << 15, 32, 4, 2
BLOCK = 1 << 9
CHUNK = 1 << 19
_CLASS = np.full(256, 1, np.uint8)  # letters, digits and bytes beyond ASCII
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 2
N_FEATURES = 2 * DIM + 4


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    place = np.argsort(r.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    return place.astype(np.int32), r.choice(np.array([-1.0, 1.0], np.float32), (SLOTS, NONZERO))


_PLACE, _SIGN = _index_vectors()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the runs of letters or of marks, and the offsets of the texts in them."""
    kind = _CLASS[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    seen = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    return (word_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) % SLOTS, np.searchsorted(starts, offsets)


def _slots(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch["text"])
    for i, j in runs(offsets, CHUNK):
        at = offsets[i : j + 1]
        yield i, j, *tokens(data[at[0] : at[-1]], at - at[0])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all slots, from every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * DIM, np.int64)
        for batch in batches:
            for _, _, slot, at in _slots(batch):
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                pairs = [(slot[:-r][same], slot[r:][same]) for r in range(1, REACH + 1) for same in (doc[r:] == doc[:-r],)]
                of = np.concatenate([x for a, b in pairs for x in (a, b)])
                near = np.concatenate([x for a, b in pairs for x in (b, a)])
                place = ((of * DIM).astype(np.int32)[:, None] + _PLACE[near]).ravel()
                total += np.bincount(place, _SIGN[near].ravel(), SLOTS * DIM).astype(np.int64)
        blocks = total.reshape(-1, BLOCK * DIM)
        some = np.flatnonzero(blocks.any(1))
        salt = TaskContext.get().partitionId() % 256
        yield pa.record_batch({"block": pa.array(some, pa.int32()), "salt": pa.array(np.full(len(some), salt), pa.int32()), "sums": pa.array([blocks[i].tobytes() for i in some], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * DIM, np.int64)
        for x in group["sums"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, sums binary"
    sums = docs.mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    vectors = np.zeros((SLOTS // BLOCK, BLOCK * DIM), np.float32)
    for r in sums.collect():  # SLOTS / BLOCK rows
        vectors[r.block] = np.frombuffer(r.sums, np.int64)
    vectors = vectors.reshape(SLOTS, DIM)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features): means over the document's tokens."""
    own = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(own, _PLACE.astype(np.int64), _SIGN, 1)
    both = docs.sparkSession.sparkContext.broadcast(np.hstack([vectors, own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = both.value
        for batch in batches:
            out = np.zeros((batch.num_rows, N_FEATURES), np.float32)
            for i, j, slot, at in _slots(batch):
                n = np.diff(at)
                some = np.flatnonzero(n)
                for k in some.tolist():
                    ids = slot[at[k] : at[k + 1]]
                    mean = out[i + k]
                    counts = np.bincount(ids, minlength=SLOTS) if len(ids) > SLOTS else None
                    mean[: 2 * DIM] = counts @ table / len(ids) if counts is not None else table[ids].mean(0)
                    mean[2 * DIM] = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0
                    mean[2 * DIM + 1] = len(np.unique(ids)) / len(ids)
                    mean[2 * DIM + 2] = np.log1p(len(ids)) / 10
                    mean[2 * DIM + 3] = 1
            yield pa.record_batch({"doc_id": batch["doc_id"], "features": pa.array([x.tobytes() for x in out], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on the cross-entropy, then a temperature from every sixth row, which the fit does not see."""
    out = np.arange(len(y)) % 6 == 0
    r = np.random.default_rng(seed)
    rate = (y.sum() + 1) / (len(y) + 2)
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max() or (~out).sum() < 10:
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    a, b = x[~out], y[~out]
    net = Network(a.mean(0), a.std(0) + 1e-3, r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), 0.0)
    a = (a - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = r.permutation(len(b))
        for i in range(0, len(b), 128):
            pick = order[i : i + 128]
            h = a[pick] @ weights[0] + weights[1]
            on = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(on @ weights[2] + weights[3], -30, 30)))
            e = (p - b[pick]) / len(pick)
            back = np.outer(e, weights[2]) * (h > 0)
            grads = [a[pick].T @ back + 1e-4 * weights[0], back.sum(0), on.T @ e + 1e-4 * weights[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                weights[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(weights[3][0])
    logit, truth = net.logit(x[out]), y[out]
    grid = np.exp(np.linspace(-1.5, 3, 91))
    loss = [np.mean(np.logaddexp(0, -np.where(truth > 0, 1, -1) * logit / g)) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for each row with an id.

    Learns from at most ``fit_rows`` labelled rows (those of the smallest hashes) of the folds other than ``held_out``; the
    word vectors come from all documents. A document that any of its labels calls bad counts as bad. Null and empty texts
    have zero features and are scored too; texts of any length are read whole; rows that share an id are scored each.
    Without labels of both kinds each score is their base rate.
    """
    docs = id_text(docs)
    fold = f"pmod(crc32(cast(doc_id as string)), {folds})"
    features = cut(pooled(docs, word_vectors(docs)))
    sample = labels.where(f"quality in (0, 1) and {fold} <> {held_out}").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = features.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()  # broadcast: fit_rows rows
    x = np.array([np.frombuffer(r.features, np.float32) for r in rows], np.float64).reshape(-1, N_FEATURES)
    net = fit(x, np.array([r.quality for r in rows], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(f, np.float32) for f in batch["features"].to_pylist()], np.float64).reshape(-1, N_FEATURES)
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(net.score(x))})

    return features.mapInArrow(run, "doc_id long, score double").selectExpr("doc_id", f"{fold} = {held_out} held_out", "score", f"if(score >= {threshold}, 1, 0) predicted")
