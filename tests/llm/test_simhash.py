import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import _forest, near_links, simhash_dedup


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_simhash_equals_brute_force(spark):
    r = random.Random(5)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    docs = {}
    for i in range(60):
        docs[i] = " ".join(r.choice(words) for _ in range(r.randint(0, 150)))
    for i in range(60, 160):
        t = docs[r.randrange(60)].split(" ")
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        docs[i] = r.choice([" ", "\n"]).join(t)
    docs |= {300: None, 301: "", 302: "one", 303: "ONE", 304: " \t"}
    prints = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = closure(docs, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, fp string").repartition(3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash_dedup(frame).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    assert simhash_dedup(frame.where("false")).count() == 0


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    """A dense group larger than a task takes, with chains of near fingerprints."""
    r = random.Random(6)
    base = r.getrandbits(63)
    prints = {base}
    while len(prints) < 500:
        f = r.choice(sorted(prints)) if r.random() < 0.7 else base
        for _ in range(r.randint(1, 5)):
            f ^= 1 << r.randrange(63)
        prints.add(f)
    prints |= {r.getrandbits(63) for _ in range(200)}
    want = closure(sorted(prints), lambda a, b: bin(a ^ b).count("1") <= 4)
    frame = spark.createDataFrame([(f,) for f in prints], "fp long")
    for group in (8192, 50):
        monkeypatch.setattr(simhash, "GROUP", group)
        roots = {x.u: x.root for x in components(near_links(frame)).collect()}
        assert {f: roots.get(f, f) for f in prints} == want


def test_forest_joins_dense_tiles():
    f = np.unique(np.array([7 << 40 | 1 << b | 1 << c for b in range(30) for c in range(30)], np.uint64))
    assert len(set(_forest(f, 4).tolist())) == 1
