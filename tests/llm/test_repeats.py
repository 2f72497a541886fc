import hashlib
import random
import re

import numpy as np

from ledgerloom.llm import common, difference_cover, repeats, suffix_array
from ledgerloom.llm.difference_cover import difference_cover_dedup
from ledgerloom.llm.suffix_array import suffix_array_dedup


def brute(texts, size, split, join):
    """Removes what an earlier window covers, by a dictionary of all windows."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        tokens = split(texts[doc_id])
        gone = [False] * len(tokens)
        for i in range(len(tokens) - size + 1):
            window = tuple(tokens[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = join([t for t, g in zip(tokens, gone) if not g])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(tokens), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ")[0] for _ in range(r.randint(1, 4))).strip() or "x"
    vocabulary = [word() + str(i) for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [text(r.randint(8, 60)) for _ in range(6)]
    docs = {}
    for i in range(70):
        pieces = [text(r.randint(0, 40)) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randint(0, 5))]
        docs[i] = r.choice([" ", "\n", "  "]).join(pieces)
    for i in range(70, 90):
        docs[i] = docs[r.randrange(70)]
    for i in range(90, 120):
        words = docs[r.randrange(70)].split(" ")
        for _ in range(r.randint(0, 3)):
            words.insert(r.randint(0, len(words)), r.choice(vocabulary))
        docs[i] = " ".join(words)
    docs |= {200: "a" * 700, 201: "ab" * 400, 202: "", 203: None, 204: "x y " * 300, 205: "y x " * 90, 206: "a" * 99, 207: "a" * 100}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "odd") for i, t in docs.items()], "doc_id long, text string, part string, kind string").repartition(5)


def test_suffix_array_equals_brute_force(spark):
    docs = corpus()
    want = brute({i: t or "" for i, t in docs.items()}, 100, lambda t: list(t.encode()), bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.digests(suffix_array_dedup(frame(spark, docs))).collect()}
    assert got == want


def test_difference_cover_equals_brute_force(spark):
    docs = corpus(2)
    split = lambda t: [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    want = brute({i: t or "" for i, t in docs.items()}, 20, split, b" ".join)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in difference_cover.digests(difference_cover_dedup(frame(spark, docs))).collect()}
    assert got == {i: (a, b, d) for i, (a, b, c, d) in want.items()}


def test_rows_that_share_an_id_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    for f in (suffix_array_dedup, difference_cover_dedup):
        rows = sorted((r.doc_id, len(r.spans) > 0) for r in f(docs).collect())
        assert rows == [(1, False), (1, False), (2, True)]
        assert f(docs.where("false")).count() == 0


def test_very_long_texts_and_a_hot_text(spark):
    """Texts above the size that a task works on at once, with repeats across its pieces, and one text that is most rows."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(5000)]
    words = [r.choice(vocabulary) for _ in range(100_000)]
    other = list(words)
    for _ in range(900):
        other[r.randrange(len(other))] = "changed"
    hot = " ".join(words[500:560])
    docs = {1: " ".join(words), 2: " ".join(words[:300] + other[40_000:] + words[:300])} | {i: hot for i in range(10, 400)} | {500: None}
    assert len(docs[1]) > 1 << 19
    for digests, f, size, split, join in (
        (suffix_array.digests, suffix_array_dedup, 100, lambda t: t.encode(), bytes),
        (difference_cover.digests, difference_cover_dedup, 20, lambda t: [x.encode() for x in t.split(" ") if x], b" ".join),
    ):
        seen, want = set(), {}
        for i, t in sorted(docs.items()):
            tokens = split(t or "")
            gone = bytearray(len(tokens))
            for k in range(len(tokens) - size + 1):
                window = hash(tokens[k : k + size] if isinstance(tokens, bytes) else tuple(tokens[k : k + size]))
                if window in seen:
                    gone[k : k + size] = b"\1" * size
                seen.add(window)
            want[i] = (sum(gone), hashlib.sha256(join([x for x, g in zip(tokens, gone) if not g])).hexdigest())
        assert {x.doc_id: (x.n_removed, x.kept_sha256) for x in digests(f(frame(spark, docs))).collect()} == want


def test_words_that_meet_in_a_polynomial_hash_are_not_equal(spark):
    """Words of 1,024 letters, one the complement of the other in Thue-Morse order."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    first, second = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    common = " ".join(f"w{i}" for i in range(19))
    for shorten in (1024, 128, 96):
        frame = spark.createDataFrame([(1, f"{common} {first[:shorten]}"), (2, f"{common} {second[:shorten]}"), (3, f"{common} {first[:shorten]}")], "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in difference_cover.digests(difference_cover.difference_cover_dedup(frame)).collect()}
        assert got == {1: 0, 2: 0, 3: 20}


def test_word_marks_are_of_the_bytes_alone():
    r = random.Random(6)
    words = [bytes(r.choice(b"ab\xc3\xa9z") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 127, 128, 129, 700]))) for _ in range(3000)]
    words = words + words[::-1]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    a, b = common.word_marks(data, starts, ends)
    for marks in (a, b):
        known = {}
        for w, m in zip(words, marks.tolist()):
            assert known.setdefault(w, m) == m
        assert len(set(known.values())) == len(known)
    assert (a != b).all()


def test_number_of_parts():
    assert common.parts_of(0) == 1 and common.parts_of(170 << 20) == 43
    assert 20_000 <= common.parts_of(80 << 30) <= 20_480
    assert common.parts_of(10**14) < 800_000 and 10**14 // common.parts_of(10**14) <= 128 << 20


def test_more_parts_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKETS", 3)
    monkeypatch.setattr(repeats, "parts", lambda docs: 17)
    r = random.Random(2)
    texts = [" ".join(r.choice("abcd") for _ in range(r.choice([5, 40, 90]))) for _ in range(60)]
    texts += texts[:20]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = {x.doc_id: x.kept_sha256 for x in difference_cover.digests(difference_cover.difference_cover_dedup(frame)).collect()}
    monkeypatch.undo()
    assert few == {x.doc_id: x.kept_sha256 for x in difference_cover.digests(difference_cover.difference_cover_dedup(frame)).collect()}
