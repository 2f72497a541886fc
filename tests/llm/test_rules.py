import math
import random
import re

from ledgerloom.llm.rules import binomial_tail, log_gamma, measures, quality_rules
from ledgerloom.llm.sharding import minimax_shards
from ledgerloom.llm import sharding
from pyspark.sql import functions as F


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    gone = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            gone |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(gone)


def test_measures_equal_brute_force(spark):
    r = random.Random(1)
    docs = {1: None, 2: "", 3: " \n\t\x0b\x0c\r ", 4: "a b c d e f g h " * 3, 5: "é#\n\n#\né#\né#", 6: "|x|" * 9 + "\n \n \nq"}
    for i in range(10, 60):
        docs[i] = "".join(r.choice(["a", "b", "é"]) + r.choice([" ", " ", "\n", "  ", "\t#", " "]) for _ in range(r.randint(0, 60)))
    frame = spark.createDataFrame([(i, t, None, 3) for i, t in docs.items()], "doc_id long, text string, lang string, words int")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in measures(frame).collect()}
    assert got == {i: slow(t) for i, t in docs.items()}


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((10, 0, 0.1), (200, 3, 0.05), (5000, 12, 0.008), (100000, 700, 0.0083)):
        want = math.log(math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))
        got = spark.createDataFrame([(float(k), float(n))], "k double, n double").select(binomial_tail("k", "n", p)).first()[0]
        assert abs(got - want) < 1e-6 * max(1, abs(want))
    assert abs(spark.range(1).select(F.expr(log_gamma("3.5d"))).first()[0] - math.lgamma(3.5)) < 1e-10


def test_cutoffs_are_admitted_by_labels(spark):
    """A rule that good documents keep is admitted; one that they break is not; few labels admit nothing."""
    r = random.Random(2)
    rows = []
    for i in range(4000):
        lang = "a" if i < 3500 else "b" if i < 3990 else "few"
        bad = i % 5 == 0
        words = [f"w{r.randrange(10**6)}" for _ in range(40)]
        if bad:
            words = [w + "##" for w in words]
        if lang == "b":
            words = [w + "|" for w in words]  # good documents there carry symbols
        rows.append((i, " ".join(words), lang, 0 if bad else 1))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, quality int")
    kept = {x.doc_id: x.kept for x in quality_rules(docs, labels).collect()}
    assert not any(kept[i] for i in range(0, 3500, 5))
    assert all(kept[i] for i in range(3500) if i % 5)
    assert all(kept[i] for i in range(3500, 4000) if i % 5)
    none = quality_rules(docs, labels.where("false"))
    assert none.where("not kept").count() == 0
    assert quality_rules(docs.where("false"), labels).count() == 0


def best(sizes, shards):
    """Smallest capacity, by trying all."""
    low = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        n, room = 1, low
        for s in sizes:
            if s > room:
                n, room = n + 1, low
            room -= s
        if n <= shards:
            return low
        low += 1


def test_shards_are_minimax_and_atomic(spark, monkeypatch):
    r = random.Random(4)
    for held, seed in ((20000, 1), (3, 2), (3, 3)):
        monkeypatch.setattr(sharding, "HELD", held)
        r.seed(seed)
        docs = [(i * 3, r.choice([None, "", "same é text " * 9, "x" * r.randint(0, 200), f"t{i}"]), "k") for i in range(120)] + [(5, "same é text " * 9, "k")]
        frame = spark.createDataFrame(docs, "doc_id long, text string, text_key string")
        for shards in (8, 1, 3):
            rows = minimax_shards(frame, shards).collect()
            assert len(rows) == len(docs)
            groups = {}
            for i, t, _ in sorted(docs):
                groups.setdefault(t or "", []).append(len((t or "").encode()) + 1)
            capacity = best([sum(g) for g in groups.values()], shards)
            text = {i: t or "" for i, t, _ in docs}
            of = {}
            loads = [0] * shards
            for x in rows:
                assert of.setdefault(text[x.doc_id], x.shard) == x.shard
                loads[x.shard] += x.size
            assert max(loads) == capacity or max(loads) <= capacity
            for s in range(shards):
                assert sorted(x.slot for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))
    assert minimax_shards(frame.where("false")).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    """A long text is measured and placed whole, and columns that bear the names of measures don't matter."""
    long = "many different words " * 30_000 + "\n" + " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long, "en", -1, True), (2, "one two", "en", -1, True), (3, None, None, None, None)], "doc_id long, text string, lang string, n_symbols long, kept boolean").withColumn("n_words", F.lit("clash")).withColumn("size", F.lit(7)).withColumn("shard", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert (rows[1].n_words, rows[1].n_symbols, rows[1].n_repeat_words) == (110_000, 0, 90_000) and rows[1].base_failed and rows[2].n_words == 2 and rows[3].n_words == 0
    placed = {r.doc_id: r for r in minimax_shards(docs, 2).collect()}
    assert placed[1]["size"] == len(long.encode()) + 1 and placed[3]["size"] == 1 and placed[1].shard != placed[2].shard
