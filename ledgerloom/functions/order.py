"""Ranks and row numbers where one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import cut


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row among the rows of its groups, in an order that should have no ties.

    Rows are put in order by ranges of (groups, order), so a group of any size is spread over the tasks that its share of the rows
    deserves; places within a task are added to how many rows of the group stand in the ranges before. Null groups are a group.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    spans = placed.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the group has ranges
    spans = cut(spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_first", "_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(spans, same).select(*columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(out))


def number_rows(df: DataFrame, out: str = "row_index", start: int = 0) -> DataFrame:
    """df with gapless row numbers; rows of files are numbered in the order of file names and of their places in them.

    Two narrow passes: rows are written as they come with the piece of file they come from, pieces are counted, and what stands in the
    pieces before is added. Rows that come from no file keep the order of their partitions.
    """
    columns = df.columns
    try:
        piece = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
        piece.schema  # noqa: B018  only rows that are read from files have this
    except Exception:
        piece = df.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_start"))
    placed = cut(piece.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    pieces = placed.groupBy("_file", "_start", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_start", "_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as pieces of files
    pieces = cut(pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return placed.join(pieces, ["_file", "_start", "_part"]).select(*columns, (F.col("_at") - F.col("_first") + F.col("_before") + start).alias(out))
