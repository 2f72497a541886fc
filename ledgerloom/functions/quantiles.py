"""Exact percentiles of groups of any size: a sketch brackets the ranks, counting selects inside the brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import cut

#: Rows of a group whose values one aggregation may hold, and values that a bracket may hold when it is sorted.
HELD, INSIDE = 2_000_000, 1_000_000
#: Of the sketch, and of the bins that narrow a bracket which still holds too many values.
ACCURACY, BINS = 10_000, 1000


def exact_percentiles(df: DataFrame, groups: list[str], columns: list[str], ps: list[float], held: int = HELD, inside: int = INSIDE) -> DataFrame:
    """Groups with an array of percentiles for each column, as ``percentile`` gives them; a column without values gives null.

    Where no group has more than ``held`` rows this is one aggregation. Otherwise a first pass brackets each wanted rank with a
    sketch of bounded size, a second counts what lies below each bracket, and only values inside are grouped and sorted; a bracket
    that holds over ``inside`` of them is narrowed by counting bins first. Null groups are a group.
    """
    largest = df.groupBy(*groups).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if largest <= held:
        return df.groupBy(*groups).agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, ps))).alias(c) for c in columns))
    keys = df.select(*groups).distinct().withColumn("_g", F.monotonically_increasing_id())
    keys = cut(keys)
    same = lambda a, b: F.expr(" and ".join(f"{a}.`{g}` <=> {b}.`{g}`" for g in groups) or "true")
    long = df.alias("d").join(keys.alias("k"), same("d", "k")).select("_g", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"d.{c}").cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x")).select("_g", "x.*").where("v is not null")
    wide = 2 / ACCURACY
    marks = F.array(*(F.lit(min(1.0, max(0.0, p + e))) for p in ps for e in (-wide, wide)))
    sketch = long.groupBy("_g", "f").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.percentile_approx("v", marks, ACCURACY).alias("q"))
    # a target is a rank, counted from 0, with the bracket in which its value lies
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    target = lambda i, p, r: F.struct(F.lit(i).alias("p"), r(at(p)).cast("long").alias("r"), (F.col("q")[2 * i] if p > wide else F.col("a")).alias("lo"), (F.col("q")[2 * i + 1] if p < 1 - wide else F.col("b")).alias("hi"))
    targets = cut(sketch.select("_g", "f", "n", F.explode(F.array(*(target(i, p, r) for i, p in enumerate(ps) for r in (F.floor, F.ceil)))).alias("t")).select("_g", "f", "n", "t.*").distinct())
    brackets = lambda: targets.groupBy("_g", "f").agg(F.collect_list(F.struct("p", "r", "lo", "hi")).alias("t"))  # noqa: E731  two for each percentile
    while True:
        met = long.join(brackets(), ["_g", "f"]).select("_g", "f", "v", F.explode(F.filter("t", lambda t: F.col("v") <= t["hi"])).alias("t"))
        width = (F.col("t.hi") - F.col("t.lo")) / BINS
        bin_ = F.when(F.col("v") < F.col("t.lo"), -1).when(width > 0, F.least(F.floor((F.col("v") - F.col("t.lo")) / width), F.lit(BINS - 1))).otherwise(0).cast("int")
        counts = cut(met.groupBy("_g", "f", "t", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")))  # at most BINS + 1 rows for a target
        most = counts.where("bin >= 0").groupBy("_g", "f", "t").agg(F.sum("c").alias("c"), F.max(F.col("b") - F.col("a")).alias("w")).where("w > 0").agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
        if most <= inside:
            break
        upto = F.sum("c").over(Window.partitionBy("_g", "f", "t").orderBy("bin"))
        found = counts.withColumn("upto", upto).where("upto > t.r").groupBy("_g", "f", "t").agg(F.min_by(F.struct("a", "b"), "bin").alias("x"))
        targets = cut(targets.join(found.select("_g", "f", F.col("t.p").alias("p"), F.col("t.r").alias("r"), "x"), ["_g", "f", "p", "r"]).select("_g", "f", "n", "p", "r", F.col("x.a").alias("lo"), F.col("x.b").alias("hi")))
    below = counts.groupBy("_g", "f", "t.p", "t.r").agg(F.sum(F.when(F.col("bin") < 0, F.col("c")).otherwise(0)).alias("below"))
    values = met.where("v >= t.lo").groupBy("_g", "f", F.col("t.p").alias("p"), F.col("t.r").alias("r"), "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g", "f", "p", "r").orderBy("v"))
    chosen = values.withColumn("upto", upto).join(below, ["_g", "f", "p", "r"]).where("upto + below > r").groupBy("_g", "f", "p", "r").agg(F.min("v").alias("v"))
    pairs = chosen.groupBy("_g", "f", "p").agg(F.min_by("v", "r").alias("low"), F.max_by("v", "r").alias("high"), F.min("r").alias("r")).join(targets.select("_g", "f", "n").distinct(), ["_g", "f"])
    place = (F.col("n") - 1) * F.get(F.array(*map(F.lit, ps)), F.col("p"))
    value = F.when(place == F.col("r"), F.col("low")).otherwise((F.col("r") + 1 - place) * F.col("low") + (place - F.col("r")) * F.col("high"))
    rows = pairs.select("_g", "f", F.struct("p", value.alias("v")).alias("x")).groupBy("_g").pivot("f", list(range(len(columns)))).agg(F.array_sort(F.collect_list("x")))
    out = keys.join(rows, "_g", "left")
    return out.select(*groups, *(F.when(F.size(str(i)) > 0, F.transform(str(i), lambda x: x["v"])).alias(c) for i, c in enumerate(columns)))
