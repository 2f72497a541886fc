"""The queries that SQL cannot say, over whole tables, against plain scanners written line by line."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest

from ledgerloom import registry
from ledgerloom.functions import kernels
from ledgerloom.operators import documents

SF = "/root/testdata/sf0.001"
MARKS = "。！？；!?;"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def bodies(spark):
    return {r.file_name: r.body for r in documents.load_documents(documents.adapter(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def clean(text):
    lines = [x.rstrip() for x in text.split("\n")]
    for end in (0, -1):
        while lines and lines[end].strip() in ("", "---"):
            lines.pop(end)
    out = []
    for x in lines:
        if x or not out or out[-1]:
            out.append(x)
    return "\n".join(out).strip()


def sentences(text):
    out, table = [], []
    lines = text.split("\n")
    for n, line in enumerate(lines):
        end = "\n" if n < len(lines) - 1 else ""
        if line.lstrip(" \t").startswith("|"):
            table.append(line)
            continue
        if table:
            out.append("\n".join(table))
            table = []
        parts, at = [], ""
        for c in line:
            at += c
            if c in MARKS:
                parts.append(at)
                at = ""
        parts = [p for p in [*parts, at] if p.strip()]
        if parts:
            parts[-1] += end
            out += parts
    return out + (["\n".join(table)] if table else [])


def pack(units, limit, glue):
    out = []
    for u in units:
        if out and len(out[-1]) + len(glue) + len(u) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def paragraphs(text):
    out, at = [], []
    for line in text.split("\n"):
        if line.strip():
            at.append(line)
        else:
            out.append("\n".join(at))
            at = []
    return [p for p in [*out, "\n".join(at)] if p.strip()]


def pack_paragraphs(text, limit):
    out, held = [], []
    for p in paragraphs(text):
        if len(p) > limit:
            out += pack(held, limit, "\n\n") + pack(sentences(p), limit, "")
            held = []
        else:
            held.append(p)
    return out + pack(held, limit, "\n\n")


def chapters(body):
    """(title, preamble, clauses): text before the first heading goes to the first chapter."""
    out, lead, place = [], [], None
    for line in body.split("\n"):
        m = re.match(r"(##|###)[ \t]+(\S.*)$", line)
        if m and m[1] == "##":
            out.append((m[2].strip(), lead, []))
            lead, place = [], out[-1][1]
        elif m:
            if not out:
                out.append(("", lead, []))
                lead = []
            out[-1][2].append((m[2].strip(), []))
            place = out[-1][2][-1][1]
        else:
            (lead if place is None else place).append(line)
    made = [(t, clean("\n".join(p)), [(h, clean("\n".join(b))) for h, b in c]) for t, p, c in out]
    return [c for c in made if any(c)]


def test_split_headings(spark, bodies):
    want = sorted((f, n, t, len(c)) for f, b in bodies.items() for n, (t, _, c) in enumerate(chapters(b)))
    assert sorted((r.file_name, r.n, r.title, r.clauses) for r in run(spark, "split_headings")) == want


def test_clean_body(spark, docs):
    got = {r.doc_id: r.body for r in run(spark, "clean_body")}
    assert got == {i: clean("\n---\n\n" + t + "  \n\n\n\nend\n---\n") for i, t in docs.items()}


def test_clean_body_knows_every_blank_and_takes_time_that_grows_with_the_text(spark):
    blanks = [c for c in map(chr, range(0x10000)) if not c.strip() and c != "\n"]
    assert "\u3000" in blanks and "\xa0" in blanks
    texts = ["", "---", " \n---\n", "a\u3000\n\u3000\n\n\nb", "\u3000---\u3000\na\n---"]
    texts += [f"{b}\n---{b}\n\nfirst{b}\n{b}\n{b}\n  second {b}\n---\n---\nthird\n{b}---\n{b}" for b in blanks]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    got = {r.id: r.t for r in frame.select("id", documents.clean_body("text").alias("t")).collect()}
    assert got == {i: clean(t) for i, t in enumerate(texts)} | {len(texts): None}
    assert got[3] == "a\n\nb"
    began = time.time()
    assert kernels.clean_body("a\n" + "\n" * 1_000_000 + "b" + "\n \n---" * 200_000) == "a\n\nb"
    assert [c["preamble"] for c in kernels.headings("## 总则\n第一段" + "\n" * 40 + "第二段\n")] == ["第一段\n\n第二段"]
    assert time.time() - began < 5


def test_split_sentences(spark, docs):
    assert {r.doc_id: r.n for r in run(spark, "split_sentences")} == {i: len(sentences(t)) for i, t in docs.items()}


def test_pack_paragraphs(spark, docs):
    packed = {i: pack_paragraphs(t, 600) for i, t in docs.items()}
    assert {r.doc_id: (r.n, r.longest) for r in run(spark, "pack_paragraphs")} == {i: (len(p), max(map(len, p), default=None)) for i, p in packed.items()}


def test_pack_pages(spark):
    pages = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        if (r.text or "").strip(" "):
            pages[r.conv_id].append((r.turn, r.text))
    want = {(c, n): (len(t), hashlib.md5(t.encode()).hexdigest()) for c, p in pages.items() for n, t in enumerate(pack([t for _, t in sorted(p)], 2000, "\n\n"))}
    assert {(r.doc_id, r.batch_no): (r.n, r.h) for r in run(spark, "pack_pages")} == want


def test_chunk_documents(spark, bodies):
    want = defaultdict(list)
    for f, body in bodies.items():
        for title, preamble, clauses in chapters(body):
            head = f"## {title}\n\n" if title else ""
            if preamble:
                want[f] += [(title, "", head + p) for p in ([preamble] if clauses else pack_paragraphs(preamble, 600 - len(head)))]
            want[f] += [(title, h, f"{head}### {h}\n\n{b}".rstrip()) for h, b in clauses]
    got = defaultdict(list)
    keys = Counter()
    for r in sorted(run(spark, "chunk_documents"), key=lambda r: r.chunk_index):
        got[r.file_name].append((r.chapter, r.section, r.content))
        keys[r.file_name, r.chunk_key] += 1
    assert got == want and set(keys.values()) == {1}


def test_build_context(spark, docs):
    """Each hit's whole text stands once under its number; only neighbours are added to long chapters."""
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hits = defaultdict(dict)
    for r in registry.queries()["bm25_top20"](spark, SF).where("rank <= 5").collect():
        hits[r.query_id][r.id] = r["rank"]
    got = {r.query_id: r.context for r in run(spark, "build_context")}
    assert set(got) == set(hits)
    for q, own in hits.items():
        blocks = []
        for key in {(source[i], i // 100) for i in own}:
            members = sorted(i for i in docs if (source[i], i // 100) == key)
            body = {i: f"## 第{key[1]}章\n\n{docs[i]}" for i in members}
            small = sum(map(len, body.values())) <= 2000
            stay = [i for n, i in enumerate(members) if i in own or small or i % 10 == 0 or any(members[m] in own for m in (n - 1, n + 1) if 0 <= m < len(members))]
            lines = [(f"[来源{own[i]}] " if i in own else "[上下文] ") + re.sub(r"\A## [^\n]*\n+", "", body[i]).strip(" ") for i in stay]
            blocks.append((min(own[i] for i in members if i in own), key[0], f"## 第{key[1]}章\n" + "\n".join(lines)))
        assert got[q] == "\n---\n".join(t for _, _, t in sorted(blocks))


def test_results_of_a_batch_are_not_held_together():
    texts = ["a" * 40, None, "", "b" * 300, *("c" * 30 for _ in range(20)), "d" * 99]
    got = list(kernels.pieces(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["e"])]), 100))
    assert [t for p in got for t in p] == [*texts, "e"] and len(got) > 8
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 for p in got)
