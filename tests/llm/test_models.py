import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.quality import fit, quality_scores, tokens
from ledgerloom.llm.toxicity import label_model, toxicity_scores


def corpus(spark, n=700):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(600)]
    bad = ["vilest", "grubby", "rotten", "foulest", "creepy"]
    rows, truth = [], {}
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        good, toxic = r.random() > 0.3, r.random() < 0.2
        if not good:
            text = [w + "###" for w in text] if r.random() < 0.5 else [text[0]] * 30
        if toxic:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(bad) if r.random() < 0.5 else "grim" + r.choice(words))
        rows.append((i, " ".join(text), "score"))
        truth[i] = (int(good), int(toxic))
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, "word " * 30000, "x"), (None, "no id", "x")]
    labels = [(i, *truth[i]) for i in truth if i % 2 == 0] + [(0, *truth[0]), (9001, None, None), (77777, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


@pytest.mark.parametrize("f, place, folds, out", [(quality_scores, 0, 5, 0), (toxicity_scores, 1, 3, 1)])
def test_held_out_rows_are_told_apart(spark, f, place, folds, out):
    docs, labels, truth = corpus(spark)
    rows = {r.doc_id: r for r in f(docs, labels).collect()}
    assert set(rows) == set(truth) | {9001, 9002, 9003}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % folds == out) for i, r in rows.items())
    right = [rows[i].predicted == t[place] for i, t in truth.items() if rows[i].held_out]
    assert np.mean(right) > 0.93
    assert rows[9001].score == rows[9002].score
    assert f(docs.where("false"), labels).count() == 0
    assert len({r.score for r in f(docs, labels.where("false")).collect()}) == 1


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 200)
    other = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - quality, quality) quality", "if(pmod(crc32(cast(doc_id as string)), 3) = 1, 1 - toxic, toxic) toxic")
    for f in (quality_scores, toxicity_scores):
        a, b = ({r.doc_id: round(r.score, 6) for r in f(docs, x).collect()} for x in (labels, other))
        assert a == b


def test_tokens_split_letters_and_marks():
    data = np.frombuffer("ab## cd\nab##é".encode(), np.uint8)
    slot, at = tokens(data, np.array([0, 8, len(data)]))
    assert at.tolist() == [0, 3, 6] and slot[1] == slot[4] and slot[0] == slot[3] and len(slot) == 6


def test_temperature_and_one_class():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5))
    y = (r.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = fit(x, y).score(x)
    assert abs(p[y > 0].mean() - p[y < 1].mean()) > 0.2
    assert np.unique(fit(x, np.ones(600)).score(x)).size == 1


def test_label_model_discounts_copies():
    """Ten copies of a poor voter do not outvote two independent good ones."""
    r = np.random.default_rng(2)
    y = (r.random(4000) < 0.3).astype(int)
    fires = lambda hit, false: np.where(y > 0, r.random(4000) < hit, r.random(4000) < false).astype(float)
    noisy = fires(0.3, 0.2)
    v = np.stack([noisy] * 10 + [fires(0.8, 0.02) for _ in range(3)], 1)
    v = np.hstack([v, (v[:, 10:].sum(1, keepdims=True) == 0)])
    known = np.arange(4000) < 300
    post = label_model(v[~known], v[known].sum(0), y[known] @ v[known], 0.3)
    assert ((post > 0.5) == y[~known]).mean() > 0.95


def test_word_vectors_of_large_sums(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "pear fig " * 40), (2, "pear pear pear fig")], "doc_id long, text string").repartition(2)
    want = quality.word_vectors(docs)
    monkeypatch.setattr(quality, "_SIGN", quality._SIGN * 2**30)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)


def test_labels_that_disagree(spark):
    """Any label that calls a document bad or toxic decides, whatever the order of rows."""
    docs, labels, _ = corpus(spark, 300)
    plain = labels.where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    marked = plain.selectExpr("doc_id", "if(doc_id % 10 = 0, 0, quality) quality", "if(doc_id % 10 = 0, 1, toxic) toxic")
    other = marked.selectExpr("doc_id", "if(doc_id % 10 = 0, 1, quality) quality", "if(doc_id % 10 = 0, 0, toxic) toxic")
    for f in (quality_scores, toxicity_scores):
        a, b = ({r.doc_id: round(r.score, 6) for r in f(docs, x).collect()} for x in (marked, other.union(marked)))
        assert a == b
