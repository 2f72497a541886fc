"""Toxicity by weak supervision.

Voters of several kinds vote for toxic or abstain: a written lexicon by groups of insults, patterns of typography, and
words and word beginnings that a bounded sample of labelled documents suggests, kind by kind. A last voter says
clean where nothing is suspect. A generative label model estimates by expectation-maximisation over other documents the
accuracy of each voter, and from what the classes leave unexplained between two voters how correlated they are; correlated
voters share their weight. Gold labels suggest terms and say where accuracies start; the model sees no document's own label. A
linear classifier is trained on the posteriors of a bounded sample of such documents; its logits are scaled and shifted to
fit the labelled sample, and it scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text, mix, runs, text_buffer, word_bounds, word_hashes

CHUNK = 1 << 19
#: Lengths in bytes of word beginnings; 0 is the whole word.
KINDS = (0, 4, 5, 6)
#: Voters of each kind of suggested term.
VOTERS = 4
#: The written lexicon, a voter for each group.
LEXICON = (
    ("idiot", "moron", "imbecile", "dimwit", "halfwit", "stupid", "dumb", "fool"),
    ("scum", "trash", "garbage", "vermin", "filth", "lowlife", "parasite"),
    ("loser", "worthless", "pathetic", "useless", "clown", "lowbrow", "wretch"),
    ("disgusting", "vile", "repulsive", "hideous", "ugly", "creep", "pervert"),
    ("dummkopf", "trottel", "depp", "abschaum", "arschloch", "connard", "salaud", "ordure", "crétin", "imbécile", "idiota", "imbécil", "estúpido", "basura", "escoria"),
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each term, term, kind): hashes of words and of their beginnings; a text of any length in pieces of whole rows."""
    data, offsets = text_buffer(texts)
    data = np.where(_LETTER[data], _LOWER[data], np.uint8(32))
    for i, j in runs(offsets, CHUNK):
        at = offsets[i : j + 1]
        piece, at = data[at[0] : at[-1]], at - at[0]
        starts, ends, word_at = word_bounds(piece, at)
        row = np.repeat(np.arange(j - i), np.diff(word_at))
        rows, found, kinds = [], [], []
        for k, length in enumerate(KINDS):
            long = ends - starts > length
            stop = ends[long] if not length else starts[long] + length
            found.append(mix(word_hashes(piece, starts[long], stop) + np.uint64(k)))
            rows.append(row[long])
            kinds.append(np.full(len(rows[-1]), k, np.int32))
        yield i, j - i, np.concatenate(rows), np.concatenate(found), np.concatenate(kinds)


def _document_terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, term, kind) with each term once a document."""
    for i, _, row, term, kind in terms(texts):
        order = np.lexsort((row, term))
        row, term, kind = row[order], term[order], kind[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        yield i, row[new], term[new], kind[new]


def lexicon_terms() -> tuple[np.ndarray, np.ndarray]:
    """The written lexicon's terms, and the group of each."""
    words = [(w, g) for g, group in enumerate(LEXICON) for w in group]
    found = [next(terms(pa.array([w]))) for w, _ in words]
    return np.array([term[kind == 0][0] for _, _, _, term, kind in found], np.uint64), np.array([g for _, g in words])


def mined_terms(labelled: DataFrame, least: int = 3) -> DataFrame:
    """(term, kind, toxic, n): in how many of the labelled documents each term occurs, for terms of at least ``least`` toxic ones.

    The toxic documents, the fewer, give the candidates; only those are counted in the rest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch["toxic"].to_numpy()
            for i, row, term, kind in _document_terms(batch["text"]):
                if len(term):
                    at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                    toxic = np.add.reduceat((marked[i + row] == 1).astype(np.int64), at)
                    yield pa.record_batch({"term": pa.array(term[at].view(np.int64)), "kind": pa.array(kind[at], pa.int32()), "toxic": pa.array(toxic), "n": pa.array(np.diff(np.append(at, len(term))))})

    schema = "term long, kind int, toxic long, n long"
    sums = [F.sum("toxic").alias("toxic"), F.sum("n").alias("n")]
    toxic = cut(labelled.where("toxic = 1").mapInArrow(count, schema).groupBy("term", "kind").agg(*sums).where(F.col("toxic") >= least))
    clean = labelled.where("toxic = 0").mapInArrow(count, schema).join(toxic.select("term", "kind"), ["term", "kind"], "left_semi")
    return toxic.unionByName(clean.select(toxic.columns)).groupBy("term", "kind").agg(*sums)


def hits(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, hits, shouts): places in the sorted ``table`` of the terms of each document, each once, and the shares that patterns look at."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        some = np.zeros(1 << 20, bool)
        some[(table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            counts, values = [], []
            for _, n, row, term, _ in terms(batch["text"]):
                near = some[(term & np.uint64((1 << 20) - 1)).astype(np.int64)]
                row, term = row[near], term[near]
                place = np.minimum(np.searchsorted(table, term), len(table) - 1)
                true = table[place] == term
                each = np.unique(row[true] * len(table) + place[true])
                counts.append(np.bincount(each // len(table), minlength=n))
                values.append(each % len(table))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int32)
            yield pa.record_batch({"doc_id": batch["doc_id"], "hits": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "shouts": pa.array(shouts(batch["text"]))})

    return docs.mapInArrow(run, "doc_id long, hits array<int>, shouts double")


def shouts(texts: pa.Array) -> np.ndarray:
    """The share of capitals and exclamation marks among the letters and marks of each text."""
    data, offsets = text_buffer(texts)
    out = np.zeros(len(offsets) - 1)
    for i, j in runs(offsets, CHUNK):
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        loud = np.concatenate([[0], np.cumsum(((piece >= 65) & (piece <= 90)) | (piece == 33), dtype=np.int32)])
        size = np.concatenate([[0], np.cumsum(piece > 32, dtype=np.int32)])
        out[i:j] = (loud[at[1:]] - loud[at[:-1]]) / np.maximum(size[at[1:]] - size[at[:-1]], 1)
    return out


def votes(found: list[np.ndarray], shout: np.ndarray, voter_of: np.ndarray, voters: int) -> np.ndarray:
    """0/1 votes of each voter on each document: ``voters`` of terms, one for shouting, a last one that fires where no term is met."""
    out = np.zeros((len(found), voters + 2))
    for i, h in enumerate(found):
        out[i, voter_of[h]] = 1
    out[:, voters] = shout > 0.5
    out[:, voters + 1] = out[:, :voters].sum(1) == 0
    return out


def label_model(v: np.ndarray, seen: np.ndarray, right: np.ndarray, prior: float, trust: float = 3.0, rounds: int = 100) -> np.ndarray:
    """Posterior of class 1 from 0/1 votes of voters that fire or abstain; to abstain says nothing.

    seen, right: how often each voter fired on labelled documents, and on those of class 1. Their share is where each
    accuracy starts, and it is drawn to that with ``trust`` times the weight of the documents themselves; ``prior`` is the share of class 1. No document's own label is seen.
    """
    given = (right + 1.6) / (seen + 2)
    accuracy, post, base = given, np.full(len(v), prior), np.log(prior / (1 - prior))
    for k in range(rounds):
        if k % 10 == 0:  # what the classes do not explain of two voters' agreement
            fire1, fire0 = (post @ v + 0.5) / (post.sum() + 1), ((1 - post) @ v + 0.5) / ((1 - post).sum() + 1)
            rest = v - np.outer(post, fire1) - np.outer(1 - post, fire0)
            size = np.sqrt((rest**2).sum(0)) + 1e-9
            shared = np.clip(rest.T @ rest / np.outer(size, size), 0, 1)
            np.fill_diagonal(shared, 0)
            weight = 1 / (1 + shared.sum(1))
        a = np.clip(accuracy, 1e-3, 1 - 1e-3)
        new = 1 / (1 + np.exp(-np.clip(base + v @ (weight * (np.log(a / (1 - a)) - base)), -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
        met = v.sum(0)
        accuracy = (post @ v + trust * np.maximum(met, 1) * given) / (met + trust * np.maximum(met, 1))
    return post


def linear(found: list[np.ndarray], post: np.ndarray, n: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression of the posterior on the presence of terms, by Adam over all rows."""
    col = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
    row = np.repeat(np.arange(len(found)), [len(h) for h in found])
    w, b = np.zeros(n), 0.0
    m, s, mb, sb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(found))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / max(1, len(found))
        g, gb = np.bincount(col, e[row], n) + 1e-6 * w, e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-9)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of logits that fit the labels best, by Newton's steps with a slight pull to (1, 0)."""
    x, w, pull = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0]), 1e-2 * np.eye(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ (w - np.array([1.0, 0.0])))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, lexicon: int = 20_000, chance: float = 7.0, precise: float = 0.95, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for each row with an id.

    Terms are suggested by at most ``fit_rows`` labelled rows (those of the smallest hashes) of the folds other than
    ``held_out``, seven in eight of them; the ``lexicon`` most telling are kept, of a toxic share of ``precise`` or more that is
    exp(``chance``) times as likely as by the base rate. The label model and the classifier see at most ``fit_rows`` documents
    of those folds, labelled or not, and none that suggested terms. A document that any of its labels calls toxic counts as
    toxic. Null and empty texts hold no term; texts of any length are read whole; rows that share an id are scored each.
    Without labels the written lexicon and the patterns remain.
    """
    docs = id_text(docs)
    fold = f"pmod(crc32(cast(doc_id as string)), {folds})"
    known = labels.where(f"toxic in (0, 1) and {fold} <> {held_out}").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = cut(known.where("pmod(xxhash64(doc_id, 'suggests'), 8) > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    labelled = cut(docs.join(F.broadcast(sample), "doc_id"))  # fit_rows documents, unless rows share their ids
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (toxic + 1) / (n + 2)
    mined = cut(mined_terms(labelled))
    # how much likelier a term's toxic share is than the base rate, in logarithms
    gain = f"toxic * ln((toxic + 1e-9) / n / {base}) + (n - toxic) * ln(greatest(n - toxic, 1e-9) / n / {1 - base})"
    telling = mined.withColumn("precision", F.expr("cast(toxic as double) / n")).where(f"precision >= {precise} and {gain} > {chance}")
    mined = telling.orderBy(F.desc("precision"), F.desc("toxic"), "term").limit(lexicon).collect()
    written, group = lexicon_terms()
    voter = {int(np.uint64(r.term & (2**64 - 1))): len(LEXICON) + VOTERS * r.kind + (r.term & (2**64 - 1)) % VOTERS for r in mined} | dict(zip(written.tolist(), group.tolist()))
    table = np.array(sorted(voter), np.uint64)
    voter_of = np.array([voter[t] for t in table.tolist()])
    scored = cut(hits(docs, table))
    n_voters = len(LEXICON) + VOTERS * len(KINDS)

    def ballots(rows: list) -> np.ndarray:
        return votes([np.array(r.hits, np.int64) for r in rows], np.array([r.shouts for r in rows]), voter_of, n_voters)

    told = scored.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    rows = scored.where(f"{fold} <> {held_out}").join(F.broadcast(sample), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    known = ballots(told)
    post = label_model(ballots(rows), known.sum(0), np.array([r.toxic for r in told], float) @ known, base)
    found = [np.array(r.hits, np.int64) for r in rows]
    weights, bias = linear(found, post, len(table))
    scale, shift = calibrate(np.array([bias + weights[np.array(r.hits, np.int64)].sum() for r in told], float), np.array([r.toxic for r in told], float))
    weights, bias = scale * weights, scale * bias + shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([bias + weights[h].sum() for h in (np.array(x, np.int64) for x in batch["hits"].to_pylist())], float)
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return scored.mapInArrow(run, "doc_id long, score double").selectExpr("doc_id", f"{fold} = {held_out} held_out", "score", f"if(score >= {threshold}, 1, 0) predicted")
