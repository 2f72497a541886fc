
import hashlib

import numpy as np

import corpus_pipeline
from ledgerloom.llm import secret_scan
from ledgerloom.llm.decontam import Passages, find_hits
import pyarrow as pa

from .test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    first, near, clean, masked, last = (seen[n] for n in names)
    # of each group that similarities of 0.8 or more connect, the smallest id stays
    assert set(near) == {i for i, c in brute({i: r.text for i, r in first.items()}).items() if i == c}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    p = Passages.of([r.item_id for r in bench], [r.text for r in bench], 10, 0.08)
    ids = sorted(near)
    hits = find_hits(pa.array([near[i].text for i in ids]), p)
    assert set(clean) == {i for i, h in zip(ids, hits) if not h}
    assert set(masked) == set(clean) and all(not any(s["kind"] != "literal" for s in secret_scan.scan(r.text.replace("[SECRET]", "."))) for r in masked.values())
    assert set(last) == set(masked) and all(r.decoded_sha256 == hashlib.sha256(masked[i].text.encode()).hexdigest() and r.n_tokens == len(r.ids) for i, r in last.items())


def test_rejected_by_label_go(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    known = [(i in kept) == bool(q) for i, q in labels.items()]
    assert np.mean(known) > 0.9


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns and empty tables."""
    long = " ".join(f"word{i} is here" for i in range(40_000))
    rows = [(1, "plain words of a short text that nobody has seen", "en", "s", 48, 1, 0.5), (1, "plain words of a short text that nobody has seen", "en", "s", 48, 1, 0.5), (2, None, None, None, None, None, None), (3, "", "", "", 0, 0, 0.0), (4, long, "en", "s", len(long), 1, 0.1), (5, "token=abcdef123 stays out of it", "en", "s", 31, 2, 0.2), (None, "no id", "en", "s", 5, 3, 0.3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, frame, SF), stage(spark, frame.where("false"), SF)
        assert none.count() == 0
        got = out.collect()
        ids = sorted(r.doc_id for r in got if r.doc_id is not None)
        assert set(ids) <= {1, 2, 3, 4, 5}
        if name == "simhash_near_dedup":
            assert ids == [1, 1, 2, 4, 5]  # the empty text is a copy of the missing one; rows that share an id stay together
        if name in ("benchmark_decontamination", "secret_scan", "byte_bpe"):
            assert ids == [1, 1, 2, 3, 4, 5]
        if name == "secret_scan":
            assert {r.doc_id: r.text for r in got}[5] == "[SECRET] stays out of it" and {r.doc_id: r.text for r in got}[2] is None
        if name != "byte_bpe":
            assert out.columns == frame.columns
