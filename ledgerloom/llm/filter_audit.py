"""How filters interact: what each removes in every order of application, and its Shapley share.

The removal game of a part gives a coalition of filters the number of documents that fail at least one of them. Its
Hart-Mas-Colell potential is computed recursively over the 32 coalitions, P(S) = (v(S) + sum of P(S without i)) / |S|; the
Shapley value of a filter is the grand potential minus the potential without it. What a filter removes after others is a
difference of two coalitions, so the steps of all 120 orders need no further look at documents.

Documents are read once: each becomes a failure mask, and masks are counted. Everything after that is 96 counts a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

FILTERS = "ABCDE"
N = len(FILTERS)
#: Times the Shapley value: the sum over all orders. The potential times this is a whole number, as 60 is divisible by 1 to 5.
ORDERS = 120
_GAP = "[\\x20\\x09-\\x0D]+"


def _mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    few = F.size(words) < 200
    repetitive = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    shouting = 100 * (F.size(F.split(text, "[A-Z]", -1)) - 1).cast("long") > 3 * F.length(text).cast("long")
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, repetitive, shouting, text.rlike("[#$%&*|]")))), F.lit(0)).cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of the mask.

    Copies are found by SHA-256 of the whole text. Equal rows are counted before they are shuffled by text, so one text that is
    a third of the table is a few rows a task there.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("words", F.array_remove(F.split("text", _GAP), "")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), _mask(F.col("text"), F.col("words")).alias("mask"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    flagged = slim.join(flags, F.col("doc_id") == F.col("id"), "left").select("doc_id", "part", "same", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["same", "mask", "part", "good", "toxic"]
    each = flagged.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    kinds = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    # of the rows of one text and kind, those of the text's smallest id are no copies; nor are rows without an id
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    kinds = kinds.withColumn("first", first).withColumn("kept", F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    return kinds.select("part", "good", "toxic", split.alias("x")).where("x.n > 0").groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def _game(counts: str) -> Column:
    """v(S) for S = 0 to 31: how many documents fail at least one filter of S, from an array of counts by mask."""
    return F.expr(f"transform(sequence(0, {(1 << N) - 1}), s -> aggregate(sequence(1, {(1 << N) - 1}), 0L, (a, m) -> if(m & s <> 0, a + {counts}[m], a)))")


def potentials(game: str) -> Column:
    """120 times the potential of each coalition, by recursion over coalitions of one filter less."""
    without = " + ".join(f"if(s & {1 << i} <> 0, p[s ^ {1 << i}], 0L)" for i in range(N))
    return F.expr(f"aggregate(sequence(1, {(1 << N) - 1}), array(0L), (p, s) -> array_append(p, ({ORDERS}L * {game}[s] + {without}) div bit_count(s)))")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    600 rows for each part (a value of ``lang``; null counts as empty), zeros included; an empty table has no part. Null texts
    are empty ones, texts of any length are read whole. Rows that share an id are documents each, and none of them is a copy of
    another for E, which asks for a smaller id; a row without an id is a document that is no copy and has no label. A
    document is good or toxic where any label of its id says so. Columns besides doc_id, text and lang play no part.
    """
    kinds = {"total": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    masks = failure_masks(docs, labels)
    counts = masks.groupBy("part", "mask").agg(*(F.sum(c).alias(k) for k, c in kinds.items())).groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", k))).alias(k) for k in kinds))
    by_mask = lambda k: f"transform(sequence(0, {(1 << N) - 1}), m -> coalesce({k}[m], 0L))"
    games = counts.selectExpr("part", "aggregate(map_values(total), 0L, (a, n) -> a + n) total", *(f"{by_mask(k)} {k}_by" for k in kinds))
    games = games.select("part", "total", _game("total_by").alias("v"), _game("good_by").alias("good"), _game("toxic_by").alias("toxic"))
    games = cut(games.withColumn("p", potentials("v")))
    rows = [(("".join(FILTERS[i] for i in o)), k + 1, o[k], sum(1 << i for i in o[:k])) for o in permutations(range(N)) for k in range(N)]
    steps = F.explode(F.from_json(F.lit(str([{"o": o, "k": k, "i": i, "t": t} for o, k, i, t in rows])), "array<struct<o string, k int, i int, t int>>", {"allowSingleQuotes": "true"}))
    full, own = (1 << N) - 1, "shiftleft(1, x.i)"
    after = f"x.t | {own}"
    return games.select("*", steps.alias("x")).selectExpr(
        "part", "x.o filter_order", "x.k step",
        f"total - v[{after}] kept",
        f"v[{after}] - v[x.t] removed",
        f"v[{own}] - (v[{after}] - v[x.t]) redundant",
        f"v[{full}] - v[{full} ^ {own}] unique_fails",
        f"good[{after}] - good[x.t] good_lost",
        f"toxic[{after}] - toxic[x.t] toxic_lost",
        f"p[{full}] - p[{full} ^ {own}] shapley",
    )
