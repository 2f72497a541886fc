import random
from itertools import combinations

import corpus_pipeline
from ledgerloom.llm.near_copies import near_copies

SF = "/root/testdata/sf0.001"


def brute(texts):
    """Smallest id of each component of links with similarity 0.8 or more of whole five-word shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i, c in brute(texts).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect()} == want


def test_large_groups_and_short_texts(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    texts = {0: "", 1: None, 2: "a b", 3: "A  b", 4: "a b c"}
    for base in ([word() for _ in range(120)], [word() for _ in range(60)]):
        for _ in range(60):  # copies of copies, so that a leader is far from some
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            texts[len(texts)] = " ".join(w)
            if r.random() < 0.3:
                base = w
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies(frame).collect()} == brute(texts)
