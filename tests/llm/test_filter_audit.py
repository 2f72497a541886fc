import random
from fractions import Fraction
from itertools import permutations

from ledgerloom.llm.filter_audit import filter_interactions

DOCS = "doc_id long, text string, lang string, mask string, n long"  # two columns of clashing names


def brute(docs, labels):
    """Every order applied to every document, one after another."""
    good, toxic = ({i for i, *f in labels if f[k] == 1 and i is not None} for k in (0, 1))
    failing = []
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = any((u or "") == t and i is not None and j is not None and j < i for j, u, _ in docs)
        failing.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        own, shapley = [x for x in failing if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[f] += len(gone)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def got(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in docs], DOCS).repartition(3)
    rows = filter_interactions(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_equals_every_order_applied(spark):
    r = random.Random(5)
    docs = []
    for i in range(120):
        n = r.choice([0, 3, 150, 199, 200, 260])
        words = [r.choice(["aa", "Bb", "CC", "d#"]) if r.random() < 0.4 else f"w{r.randrange(10**6)}" for _ in range(n)]
        docs.append((i, r.choice([" ", "\n", "\x0b"]).join(words), r.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[r.randrange(120)][1], "en") for i in range(30)]
    docs += [(7, docs[7][1], "de"), (7, docs[7][1], "de"), (None, docs[7][1], "en"), (None, None, None), (300, None, "fr"), (301, "", "fr"), (302, "  \t", "fr")]
    labels = [(i, r.randrange(2), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_shares_add_up_to_what_all_filters_remove(spark):
    docs = [(i, "A#" * (i % 3) + " word" * (i * 40 % 500), "en") for i in range(60)]
    rows = got(spark, docs, [(0, 1, 1)])
    order = [rows["en", "ABCDE", k] for k in range(1, 6)]
    assert sum(Fraction(x[6], 120) for x in order) == 60 - order[-1][0]


def test_one_text_in_many_rows_and_a_very_long_one(spark):
    docs = [(i, "same text", "en") for i in range(3000)] + [(9000, "long word " * 300_000, "en")]
    rows = got(spark, docs, [(2, 1, 0)])
    assert rows["en", "EABCD", 1][:2] == [2, 2999] and rows["en", "EABCD", 1][4] == 1
    assert rows["en", "BACDE", 1][:2] == [3000, 1]


def test_empty_table(spark):
    assert got(spark, [], []) == {}
