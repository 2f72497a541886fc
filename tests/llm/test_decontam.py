import random
import time

import numpy as np
import pyarrow as pa

from ledgerloom.llm import decontam
from ledgerloom.llm.decontam import Passages, align, codes_of, contaminated, digests, find_hits, normal


def budget(text):
    return min(len(text) * 8 // 100, max(len(text) - 1, 0))


def distance(passage, text):
    """Least edits of the passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + 1] = r.choice([[], [t[i], "q"], ["z"]])
    return "".join(t)


def test_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = {i: prose(r.randint(8, 30)).capitalize() + "." for i in range(12)} | {50: "short", 51: None, 52: "twelve chars"}
    docs = {i: prose(r.randint(0, 60)) for i in range(20)}
    for i in range(20, 90):
        item = items[r.randrange(12)]
        docs[i] = prose(r.randint(0, 30)) + "\n" + edited(r, item, r.randint(0, max(1, len(item) // 9))).upper() + " " + prose(r.randint(0, 20))
    docs |= {200: None, 201: "", 202: "say Twelve \n Chars again", 203: items[3][: len(items[3]) // 2]}
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([*items.items(), (0, items[0])], "item_id long, text string")
    known = {i: normal(t) for i, t in items.items() if t}
    for block in (20000, 5):
        got = {x.doc_id: {h.item_id: h.edits for h in x.hits} for x in contaminated(frame, bench, block=block).collect()}
        want = {}
        for d, t in docs.items():
            found = {i: distance(x, normal(t or "")) for i, x in known.items()}
            want[d] = {i: e for i, e in found.items() if e <= budget(known[i])}
        assert got == want
    assert digests(contaminated(frame.where("false"), bench)).count() == 0
    assert digests(contaminated(frame, bench.where("false"))).where("contaminated").count() == 0


def test_alignment():
    p = Passages.of([1], ["hello world"], 10, 0.2)

    def at(region, k):
        p.budget[:] = k
        text = codes_of(region)
        out = align(text, *(np.array([x]) for x in (0, len(text), 0, -11, len(text))), p)
        return tuple(out[:, 0].tolist()) if out[0, 0] >= 0 else None

    assert at("say hello world now", 1) == (0, 4, 15)
    assert at("say helo wxorld now", 2) == (2, 4, 15)
    assert at("nothing like it", 3) is None
    assert at("", 3) is None


def brute(texts, passages):
    out = []
    for t in texts:
        found = {i: distance(normal(x), normal(t)) for i, x in passages.items()}
        out.append({i: e for i, e in found.items() if e <= budget(normal(passages[i]))})
    return out


def test_passages_that_share_text(monkeypatch):
    """Common openings, passages that differ in a few letters only, repeated letters, and parts of a text that overlap."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    opening = letters(40)
    passages = {i: opening + letters(60) for i in range(30)}
    base = letters(70)
    passages |= {100 + i: edited(r, base, 2) for i in range(30)} | {200: "a" * 50, 201: "ab" * 20, 202: "a" * 9, 203: "b"}
    texts = [opening * 3, letters(50) + edited(r, passages[3], 4) + letters(20), base + " " + base, edited(r, base, 6), "a" * 200, "ab" * 60 + "b" * 40, "aaaa", "", letters(300), edited(r, passages[7], 9)]
    for common, group, expand in ((64, 256, 1 << 22), (5, 7, 500)):
        monkeypatch.setattr(decontam, "COMMON", common)
        monkeypatch.setattr(decontam, "GROUP", group)
        monkeypatch.setattr(decontam, "EXPAND", expand)
        p = Passages.of(list(passages), list(passages.values()), 10, 0.08)
        got = [{h["item_id"]: h["edits"] for h in hits} for hits in find_hits(pa.array(texts), p)]
        assert got == brute(texts, passages)


def counted(monkeypatch):
    """How many candidates are aligned from now on."""
    n, plain = [0], decontam.align

    def align(text, begin, end, item, *more):
        n[0] += len(item)
        return plain(text, begin, end, item, *more)

    monkeypatch.setattr(decontam, "align", align)
    return n


def test_many_passages_of_one_opening_end_in_seconds(monkeypatch):
    r = random.Random(9)
    opening = "".join(r.choice("abcdefghijklmnop ") for _ in range(60))
    passages = [opening + "".join(r.choice("abcdefghijklmnop ") for _ in range(80)) for _ in range(20_000)]
    aligned = counted(monkeypatch)
    began = time.time()
    p = Passages.of(list(range(len(passages))), passages, 10, 0.08)
    hits = find_hits(pa.array([opening * 16_000, passages[77] + " " + opening * 100]), p)
    assert hits[0] == [] and [h["item_id"] for h in hits[1]] == [77]
    assert aligned[0] < 500 and time.time() - began < 60


def test_passages_that_differ_in_three_letters(monkeypatch):
    r = random.Random(3)
    base = "".join(r.choice("abcdefghijklmnop ") for _ in range(140))

    def variant():
        t = list(base)
        for i in r.sample(range(140), 3):
            t[i] = r.choice("xyzw")
        return "".join(t)

    passages = [variant() for _ in range(4000)]
    aligned = counted(monkeypatch)
    began = time.time()
    p = Passages.of(list(range(4000)), passages, 10, 0.08)
    text = " ".join([base] * 20)
    hits = find_hits(pa.array([text]), p)[0]
    assert {h["item_id"] for h in hits} == set(range(4000))
    for h in r.sample(hits, 40):
        assert h["edits"] == distance(normal(passages[h["item_id"]]), normal(text[:500]))
    assert aligned[0] < 8000 and time.time() - began < 30


def test_long_passages_beside_short_ones_and_many_repeated_rows(spark):
    r = random.Random(12)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip()
    long, short = letters(40_000), letters(90)
    changed = edited(r, long, 300)
    bench = spark.createDataFrame([(1, long), (2, short)] * 3000, "item_id long, text string").repartition(4)
    frame = spark.createDataFrame([(1, letters(500) + changed + letters(300)), (2, letters(200) + edited(r, short, 3)), (3, long[:20_000])], "doc_id long, text string")
    got = {x.doc_id: [h.item_id for h in x.hits] for x in contaminated(frame, bench).collect()}
    assert got == {1: [1], 2: [2], 3: []}


def test_characters_long_texts_and_repeated_rows(spark):
    chinese = "数据质量的规则由部门负责人每月复核一次并且记录在案以备后续检查使用"
    assert len(chinese) == 33
    wrong = chinese[:9] + "错" + chinese[10:20] + "误" + chinese[21:]
    worse = wrong[:28] + "了" + wrong[29:]
    filler = "lorem ipsum dolor sit amet " * 60_000
    rows = [(1, wrong), (2, worse), (3, filler + wrong + " " + filler), (3, filler), (4, None), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, chinese), (8, "tiny"), (9, "")], "item_id long, text string")
    got = sorted((x.doc_id, [(h.item_id, h.edits) for h in x.hits]) for x in contaminated(frame, bench).collect())
    assert got == [(1, [(7, 2)]), (2, []), (3, []), (3, [(7, 2)]), (4, []), (4, [])]


def test_texts_of_one_id_missing_ids_and_short_passages(spark):
    first, second, third = "the first of two texts of one item of the set", "quite another wording under that same item", "a passage that came without any number"
    short = ["abcdefghijklm", "abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvwxyz0123456789-+"]
    bench = spark.createDataFrame([(1, first), (1, second), (None, third), *((10 + i, t[::-1]) for i, t in enumerate(short))], "item_id long, text string")
    changed = [t[::-1].replace("g", "#") if n == 1 else t[::-1].replace("f", "#").replace("q", "#") if n == 2 else t[::-1].replace("f", "#").replace("q", "#").replace("1", "#") for n, t in enumerate(short, 1)]
    texts = {1: first, 2: second, 3: third, 4: first + " " + second, **{10 + i: "so: " + t for i, t in enumerate(changed)}, 20: "none of these"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (20000, 2):
        got = {x.doc_id: {h.item_id: h.edits for h in x.hits} for x in contaminated(frame, bench, block=block).collect()}
        assert {i: got[i] for i in (1, 2, 3, 4, 20)} == {1: {1: 0}, 2: {1: 0}, 3: {None: 0}, 4: {1: 0}, 20: {}}
        assert [got[10 + i].get(10 + i) for i in range(3)] == [1, 2, 3]
