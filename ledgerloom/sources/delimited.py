"""CSV files of any size and encoding as records, read by lines so that a file is shared by many tasks."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scratch import cut


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, part, at, raw, quotes) of each line, with the piece of file that it stands in and its place there. Bytes are as they are."""
    lines = spark.read.text(path)
    raw = F.col("value").cast("binary")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
                        raw.alias("raw"), (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def decoded(raw: Column, encoding: str) -> Column:
    """Text of bytes; null where they are none of the encoding. A carriage return at the end is part of the line's end."""
    if encoding.lower().replace("-", "") == "utf8":
        text = raw.cast("string")
        return F.when(F.is_valid_utf8(text), F.regexp_replace(F.regexp_replace(text, "\\A\ufeff", ""), "\r\\z", ""))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else bytes(b).decode(encoding).removesuffix("\r")
            except UnicodeDecodeError:
                return None

        return values.map(one)

    return run(raw)


def find_encoding(lines: DataFrame, encodings: tuple[str, ...]) -> str:
    """The first encoding that decodes every line, from one pass over them."""
    wrong = lines.agg(*(F.coalesce(F.bool_or(decoded(F.col("raw"), e).isNull()), F.lit(False)).alias(f"e{i}") for i, e in enumerate(encodings))).first()
    for e, bad in zip(encodings, wrong):
        if not bad:
            return e
    raise ValueError(f"no encoding of {encodings} reads the source")


def _before(pieces: DataFrame, **sums: Column) -> DataFrame:
    """Pieces of files with sums over the pieces of the same file before each; a file has as many rows as pieces."""
    earlier = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumns({k: c.over(earlier) for k, c in sums.items()})


def records(lines: DataFrame, encoding: str, skip_rows: int = 0) -> DataFrame:
    """(file, line, text) of each record after the skipped lines, where quoted values may go over lines; blank lines are passed over.

    A record begins where an even number of quotes stands before it in its file. Lines are counted and quotes are paired by pieces
    of files, whose counts are then added up in order; only records of several lines are gathered.
    """
    piece = ["file", "start", "part"]
    own = Window.partitionBy(*piece).orderBy("at")
    lines = cut(lines)
    counts = cut(_before(lines.groupBy(*piece).agg(F.count("*").alias("n"), F.min("at").alias("first")), lead=F.sum("n")).select(*piece, "first", F.coalesce("lead", F.lit(0)).alias("lead")))
    numbered = lines.join(counts, piece).withColumn("line", F.col("at") - F.col("first") + F.col("lead")).where(F.col("line") >= skip_rows)
    odd = F.col("quotes") % 2
    numbered = cut(numbered.select(*piece, "at", "line", "raw", odd.alias("odd"), F.coalesce(F.sum(odd).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside")))
    pairs = cut(_before(numbered.groupBy(*piece).agg(F.sum("odd").alias("n")), lead=F.sum("n")).select(*piece, F.coalesce("lead", F.lit(0)).alias("lead")))
    marked = numbered.join(pairs, piece).withColumn("begins", (F.col("inside") + F.col("lead")) % 2 == 0).drop("lead", "inside")
    text = decoded(F.col("raw"), encoding)
    single = marked.where("begins and odd = 0").select("file", "line", text.alias("text")).where("text <> ''")
    parts = cut(marked.where("not begins or odd = 1"))
    last = F.last(F.when(F.col("begins"), F.col("line")), ignorenulls=True)
    heads = _before(parts.groupBy(*piece).agg(F.max(F.when(F.col("begins"), F.col("line"))).alias("head")), carried=F.last("head", ignorenulls=True)).select(*piece, "carried")
    of = parts.withColumn("head", last.over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(heads, piece).withColumn("head", F.coalesce("head", "carried"))
    whole = of.select("file", "head", "line", text.alias("text")).groupBy("file", F.col("head").alias("first")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"))
    return single.unionByName(whole.select("file", F.col("first").alias("line"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))


def read_delimited(lines: DataFrame, encoding: str, delimiter: str = ",", skip_rows: int = 0, schema: str | None = None) -> DataFrame:
    """Rows of files whose first record after the skipped lines is a header, which must be the same in all."""
    rows = cut(records(lines, encoding, skip_rows))
    heads = rows.groupBy("file").agg(F.min_by("text", "line").alias("head"), F.min("line").alias("line"))
    headers = [r["head"] for r in heads.select("head").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("the source has no header" if not headers else "the files of the source have different headers")
    columns = next(csv.reader(headers, delimiter=delimiter))
    fields = schema or ", ".join(f"`{c}` string" for c in columns)
    body = rows.join(heads.select("file", F.col("line").alias("h")), "file").where("line > h")
    return body.select(F.from_csv("text", fields, {"sep": delimiter, "multiLine": "true", "escape": '"'}).alias("r")).select("r.*")
