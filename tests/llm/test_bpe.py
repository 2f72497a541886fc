import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgerloom.llm.bpe import decode, digests, encode, encode_decode, stitch, vocabulary

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def right():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    parts = ["hello", " world", "\n", "\n\n  x", "   ", "'re", "'ll go", "1234", " 99", "éàü", "漢字かな", "🙂🙂", "<|endoftext|>", "!!!", " ...", "\t", "a" * 90, "ab" * 60, " -- ", " ", "Ñandú"]
    return ["", " ", "a", *("".join(r.choice(parts) for _ in range(r.randint(1, 200))) for _ in range(60)), "x" * 3000, " " * 500, "word " * 400]


def test_equals_tiktoken_with_any_chunks(spark, right):
    docs = dict(enumerate(texts()))
    frame = spark.createDataFrame([(i, t) for i, t in docs.items()] + [(900, None), (3, docs[3])], "doc_id long, text string")
    for chunk, overlap in ((1 << 15, 1 << 10), (64, 32), (40, 8)):
        rows = digests(encode_decode(frame, chunk=chunk, overlap=overlap)).collect()
        assert len(rows) == len(docs) + 2
        for r in rows:
            text = docs.get(r.doc_id, "")
            ids = right.encode_ordinary(text)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_decode(frame.where("false")).count() == 0


def test_stitching_equals_one_reading():
    v = vocabulary(PATH, P.PATTERN)
    for text in texts()[3:]:
        for chunk, overlap in ((50, 10), (17, 5)):
            chunks = [(s, v.boundaries(text[s : s + chunk + overlap])) for s in range(0, len(text), chunk)]
            assert stitch(text, chunks, v) == v.find(text)



def merged(piece, ranks):
    """Merging written out: the neighbours of the lowest rank become one, until none has a rank."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate([*zip(parts, parts[1:]), (b"", b"")]))
        if best[0] == 1 << 40 or len(parts) < 2:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_a_plain_loop(spark):
    v = vocabulary(PATH, P.PATTERN)
    pieces = {p for t in texts() for p in v.find(t)} | {"ß" * 40, "strengthlessness", " Donaudampfschiff", "\u0301\u0301"}
    for piece in pieces:
        if len(piece) <= 500:
            own = piece.encode()
            assert list(v[piece]) == ([v.rank[own]] if own in v.rank else merged(own, v.rank))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    memo = {}
    for r in encode_decode(docs).collect():
        ids = []
        for piece in v.find(known[r.doc_id]):
            if piece not in memo:
                own = piece.encode()
                memo[piece] = [v.rank[own]] if own in v.rank else merged(own, v.rank)
            ids += memo[piece]
        assert r.ids == ids and bytes(r.decoded).decode() == known[r.doc_id]


def test_long_pieces_are_not_remembered():
    v = vocabulary(PATH, P.PATTERN)
    v.clear()
    long = "ab" * 5000
    assert decode(encode([long, " word"], v), v) == (long + " word").encode() and set(v) == {" word"}
