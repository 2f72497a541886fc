import random
from itertools import combinations

import numpy as np

from ledgerloom.llm.minhash import collisions, minhash_dedup, signature
from ledgerloom.llm.near_copies import shingle_hashes

SF = "/root/testdata/sf0.001"


def brute(docs):
    """(doc_id, set size, component) of each row, by the similarity of all pairs of whole sets."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def got(spark, docs, parts=3):
    frame = spark.createDataFrame([(d, t, "c", 7) for d, t in docs], "doc_id long, text string, component_id string, n int").repartition(parts)
    rows = minhash_dedup(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_equals_brute_force_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(spark, docs) == brute(docs)


def test_large_groups_with_and_without_a_centre(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(9000)}"
    texts = []
    for n, copies, chained in ((110, 70, False), (140, 60, True), (60, 40, True)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(1, 2)):
                w[r.randrange(n)] = word()
            texts.append(" ".join(w))
            if chained and r.random() < 0.5:
                base = w
    r.shuffle(texts)
    assert got(spark, list(enumerate(texts))) == brute(list(enumerate(texts)))


def test_a_passage_that_many_share_links_nothing(spark):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + " " + " ".join(f"w{r.randrange(10**7)}" for _ in range(60))) for i in range(120)]
    assert got(spark, docs) == brute(docs)


def test_short_empty_and_repeated_rows_and_a_very_long_text(spark):
    long = " ".join(f"a{i % 9973} b{i}" for i in range(60_000))
    docs = [(0, ""), (1, None), (2, " \n\t"), (3, "One  two"), (4, "one\ntwo"), (5, "one two three four five"), (6, "ONE two three four five"), (7, "É a b c d"), (8, "é a b c d")]
    docs += [(20, "same text here is long enough"), (20, "same text here is long enough"), (20, "another text of that very id")] + [(30, long), (31, long + " end"), (9, long.upper())]
    assert got(spark, docs) == brute(docs)
    assert got(spark, []) == []


def test_copies_are_one_text(spark):
    docs = [(i, "the same words in very many rows") for i in range(20_000, 0, -1)]
    assert got(spark, docs, 8) == [(i, 3, 1) for i in range(1, 20_001)]


def test_collisions_estimate_similarity():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    a, b = (signature(np.unique(shingle_hashes(" ".join(w).encode())[1])) for w in (words, words[:2800]))
    assert 50 <= collisions(a[None], b[None])[0, 0] <= 64
