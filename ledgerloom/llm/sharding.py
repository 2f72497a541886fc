"""Sharding by a minimax contiguous partition, in DataFrame and SQL functions only.

Equal texts form an atomic group; groups stand in the order of their smallest doc_id. The smallest
capacity with which greedy filling needs no more than the wanted shards is searched: a round tries
many capacities at once, each of its steps one aggregation over the groups, until the groups between
the bracket's cuts are few enough to end the binary search on the driver.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, id_text

#: Capacities tried in a round; groups between the bracket's cuts that the driver may hold.
TRIED, HELD = 64, 20_000


def _step(ends: DataFrame, targets: list[int]) -> list[int]:
    """For each target the largest group end that does not exceed it, or 0."""
    marks = sorted(set(targets))
    best = {r.j: r.e for r in ends.groupBy(F.expr(f"size(filter(array({', '.join(f'{t}L' for t in marks)}), t -> t < end))").alias("j")).agg(F.max("end").alias("e")).collect()}
    out, most = {}, 0
    for j, t in enumerate(marks):
        most = max(most, best.get(j, 0))
        out[t] = most
    return [out[t] for t in targets]


def _greedy(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the ends of its shards."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        for own, e in zip(cuts, _step(ends, [(c[-1] if c else 0) + cap for c, cap in zip(cuts, capacities)])):
            own.append(max(e, own[-1] if own else 0))
    return cuts


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards under the smallest capacity that suffices."""
    low, high = max(largest, -(-total // shards)) - 1, max(largest, -(-total // shards)) + largest  # low does not suffice, or is below the bound
    cuts_low, cuts_high = [0] * shards, [total] * shards
    while high - low > 1:
        between = F.lit(False)
        for a, b in zip(cuts_low, cuts_high):
            between = between | F.col("end").between(a, b)
        held = [r.end for r in ends.where(between).select("end").distinct().limit(HELD + 1).collect()]
        if len(held) <= HELD:
            held.sort()

            def fill(capacity: int) -> list[int]:
                out, at = [], 0
                for _ in range(shards):
                    i = bisect_right(held, at + capacity)
                    at = max(at, held[i - 1] if i else 0)
                    out.append(at)
                return out

            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if fill(mid)[-1] == total else (mid, high)
            return fill(high)
        tried = sorted({low + (high - low) * i // (TRIED + 1) for i in range(1, TRIED + 1)} - {low, high})
        found = _greedy(ends, [*tried, high], shards)
        for capacity, cuts in zip([*tried, high], found):
            if cuts[-1] == total:
                high, cuts_high = capacity, cuts
                break
            low, cuts_low = capacity, cuts
    return _greedy(ends, [high], shards)[0]


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot and grown_shard (null) for each row with an id.

    Null texts count as empty ones (size 1). Equal texts share a shard; slots run from 0 in each shard without a gap.
    With fewer groups than shards, some shards stay empty. A text of any length is an item of its size, which may be most of a
    shard; rows that share an id each have a slot.
    """
    spark = docs.sparkSession
    sized = cut(id_text(docs).selectExpr("doc_id", "cast(octet_length(text) + 1 as long) size", "crc32(text) text_crc32", "md5(text) text_key"))
    firsts = cut(sized.groupBy("text_key").agg(F.min("doc_id").alias("first")))  # written, so that Spark can split a hot text in the join
    order = ["first", "text_key", "doc_id"]
    # a large group spans several ranges, since doc_id is part of the order
    ranged = cut(cut(sized.join(firsts, "text_key")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("block", F.spark_partition_id()))
    blocks = ranged.groupBy("block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    blocks = cut(blocks.select("block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before")))
    own = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(
        ranged.withColumns({"upto": F.sum("size").over(own), "row": F.row_number().over(own)})
        .join(F.broadcast(blocks), "block")
        .selectExpr("doc_id", "size", "text_crc32", "first", "text_key", "upto + size_before upto", "row + rows_before row")
    )
    ends = cut(placed.groupBy("first", "text_key").agg(F.max("upto").alias("end"), F.max("row").alias("end_row"), F.sum("size").alias("size")).select("end", "end_row", "size"))
    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    cuts = smallest_capacity(ends, total, largest, shards) if total else [0] * shards
    rows_at = {r.end: r.end_row for r in ends.where(F.col("end").isin(sorted(set(cuts)))).collect()} | {0: 0}
    marks = ", ".join(f"{c}L" for c in cuts[:-1]) or "0L"
    starts = ", ".join(f"{rows_at[c]}L" for c in [0, *cuts[:-1]])
    shard = f"size(filter(cast(array({marks}) as array<long>), c -> c < upto))" if shards > 1 else "0"
    return placed.withColumn("shard", F.expr(f"cast({shard} as int)")).selectExpr("doc_id", "size", "text_crc32", "'bytes' law", "shard", f"cast(row - 1 - array({starts})[shard] as long) slot", "cast(null as int) grown_shard")
