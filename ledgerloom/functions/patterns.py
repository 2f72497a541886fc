"""Which of many names a text contains: one pass of an automaton over the text, however many names there are."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Bytes of names that one automaton takes; a longer list is met in several passes.
NAME_BYTES = 16 << 20


def find_names(df: DataFrame, names: DataFrame, text: str, name: str = "name", out: str = "names", most: int = NAME_BYTES) -> DataFrame:
    """df with an array ``out`` of the distinct names (a column of ``names``) that stand in its text, in order.

    The names are sent to the tasks as text, at most about ``most`` bytes at a time, and made into an automaton there, so a row costs
    as much as its text is long. Null and empty names are in no text, a null text contains none.
    """
    names = names.select(F.col(name).cast("string").alias("n")).where("n <> ''").distinct()
    size = names.agg(F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most))
    spark, columns = df.sparkSession, df.columns
    df = df.withColumn(out, F.expr("cast(array() as array<string>)"))
    for b in range(blocks):
        own = names.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b) if blocks > 1 else names
        shared = spark.sparkContext.broadcast([r.n for r in own.collect()])
        built: list = []

        @F.pandas_udf("array<string>")
        def found(texts: pd.Series) -> pd.Series:
            if not built:
                automaton = ahocorasick.Automaton()
                for n in shared.value:
                    automaton.add_word(n, n)
                automaton.make_automaton()
                built.append(automaton)
            return texts.map(lambda t: sorted({n for _, n in built[0].iter(t)}) if t and len(built[0]) else [])

        df = df.withColumn(out, F.array_union(out, found(text)))
    return df.select(*columns, F.array_sort(out).alias(out))
