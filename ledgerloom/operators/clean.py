"""Cleaning of collected batches. Every operator works on all batches at once, by ``batch_id``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order import rank_in_groups
from ..functions.quantiles import exact_percentiles

KEY_WORDS = ("id", "编号", "日期", "date", "name", "姓名")
DATE_WORDS = ("date", "日期", "时间")
NOT_ANOMALOUS = "复核后判定为正常"
CANDIDATE_SCHEMA = "batch_id string, record_index long, field string, value double, q1 double, q3 double, iqr double, deviation double"


def find_key_columns(columns: list[str], most: int = 3) -> list[str]:
    """The first columns whose header names an id, a date or a person."""
    return [c for c in columns if any(w in c.lower() for w in KEY_WORDS)][:most]


def dedup_keep_first(df: DataFrame, keys: list[str], order_col: str, batch: str = "batch_id") -> DataFrame:
    """The first row by ``order_col`` of each key (nulls are equal); all columns are the key when there are none.

    An aggregation rather than a window: it combines before the shuffle, so a key with very many copies is no burden.
    """
    keys = keys or [c for c in df.columns if c not in (batch, order_col)]
    by = [batch, *keys] if batch in df.columns and batch not in keys else keys
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.col(order_col)).alias("row")).select("row.*")


def _numbers(df: DataFrame, cols: list[str] | None, skip: tuple[str, ...]) -> list[str]:
    return cols if cols is not None else [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int", "smallint") and c not in skip]


def _texts(df: DataFrame, cols: list[str] | None, skip: tuple[str, ...]) -> list[str]:
    return cols if cols is not None else [c for c, t in df.dtypes if t == "string" and c not in skip]


def fill_missing(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None, skip: tuple[str, ...] = ("batch_id", "record_index"), approx: bool = False, batch: str = "batch_id") -> DataFrame:
    """Median for numbers, most frequent value (the smallest of equals) for text, by batch; columns without values stay.

    Medians are exact at any size of a batch; with ``approx`` they are values of the column, from one aggregation.
    """
    numeric, categorical = _numbers(df, numeric, skip), _texts(df, categorical, skip)
    medians = [F.percentile_approx(c, 0.5).alias(f"_fill_{c}") for c in numeric] if approx else []
    modes = [F.mode(c, True).alias(f"_fill_{c}") for c in categorical]
    stats = df.groupBy(batch).agg(*medians, *modes) if medians or modes else df.select(batch).distinct()
    filled = df.join(stats, batch)
    if numeric and not approx:
        filled = filled.join(exact_percentiles(df, [batch], numeric, [0.5]).select(batch, *(F.get(c, F.lit(0)).alias(f"_fill_{c}") for c in numeric)), batch)
    return filled.select(*(F.coalesce(c, f"_fill_{c}").alias(c) if c in numeric or c in categorical else F.col(c) for c in df.columns))


def missing_stats(before: DataFrame, after: DataFrame, cols: list[str], batch: str = "batch_id") -> DataFrame:
    """Missing cells before and after, and the share of all cells that were missing."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(batch).agg(sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias(name), F.count("*").alias("rows"))

    return count(before, "missing_before").join(count(after, "missing_after").drop("rows"), batch).withColumn("missing_rate", F.col("missing_before") / (F.col("rows") * F.lit(len(cols))))


def iqr_candidates(df: DataFrame, cols: list[str], index: str = "record_index", batch: str = "batch_id", digits: int = 2, approx: bool = False) -> DataFrame:
    """Values strictly outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR of their batch and column; columns of IQR 0 are passed over.

    Quartiles go back to the rows as one wide row for each batch, so only outliers become rows of their own. They are exact
    at any size of a batch; with ``approx`` they are values of the column, from one aggregation.
    """
    at = [0.25, 0.5, 0.75]
    quarters = df.groupBy(batch).agg(*(F.percentile_approx(F.col(c).cast("double"), at).alias(c) for c in cols)) if approx else exact_percentiles(df, [batch], cols, at)
    quarters = quarters.select(batch, *(F.col(c).alias(f"_q_{c}") for c in cols))

    def outlier(pos: int, c: str) -> Column:
        v, q = F.col(c).cast("double"), F.col(f"_q_{c}")
        iqr = q[2] - q[0]
        found = F.struct(F.lit(c).alias("field"), F.lit(pos).alias("col_pos"), v.alias("value"), q[0].alias("q1"), q[2].alias("q3"), iqr.alias("iqr"), F.round(F.abs(v - q[1]) / iqr, digits).alias("deviation"))
        return F.when((iqr > 0) & ((v < q[0] - 1.5 * iqr) | (v > q[2] + 1.5 * iqr)), found)

    found = F.filter(F.array(*(outlier(i, c) for i, c in enumerate(cols))), lambda x: x.isNotNull())
    return df.join(quarters, batch).select(batch, index, F.explode(found).alias("x")).select(batch, index, "x.*")


def rank_candidates(candidates: DataFrame, size: int = 30, batch: str = "batch_id") -> DataFrame:
    """Order by deviation (then column, then row) within the batch, of any size, and the review batch of ``size`` rows."""
    ranked = rank_in_groups(candidates, [batch], [F.desc("deviation"), "col_pos", "record_index"])
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("review_batch", F.floor((F.col("rank") - 1) / size))


def severity_band(deviation: Column) -> Column:
    return F.when(deviation >= 3, "extreme").when(deviation >= 2, "high").when(deviation >= 1.5, "medium").otherwise("low")


def basic_stats(df: DataFrame, cols: list[str], batch: str = "batch_id", approx: bool = False) -> DataFrame:
    """Mean, median, least and largest of each numeric column, rounded to one place; with ``approx`` the median is a value of the column."""
    long = lambda rows, value: rows.select(batch, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), value(c).alias("v")) for c in cols))).alias("x")).select(batch, "x.*").where("v is not null")
    values = long(df, lambda c: F.col(c).cast("double"))
    middle = [F.round(F.percentile_approx("v", 0.5), 1).alias("median")] if approx else []
    out = values.groupBy(batch, "field").agg(F.round(F.avg("v"), 1).alias("mean"), *middle, F.round(F.min("v"), 1).alias("low"), F.round(F.max("v"), 1).alias("high"))
    if not approx:
        out = out.join(long(exact_percentiles(df, [batch], cols, [0.5]), lambda c: F.get(c, F.lit(0))).select(batch, "field", F.round("v", 1).alias("median")), [batch, "field"])
    return out.select(batch, "field", "mean", "median", "low", "high")


def judge_batches(ranked: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Verdicts of ``judge`` (one call for each review batch, at most 30 rows); a call that fails leaves its rows pending."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        out = rows[["batch_id", "record_index", "field", "value"]].assign(seq=rows["rank"].astype("int64"))
        try:
            said = judge(rows).reset_index(drop=True)
            return out.assign(is_anomaly=said["is_anomaly"].astype(bool).values, pending_review=False, reason=said["reason"].values)
        except Exception as error:  # the judge is foreign code: its failure is a result of its own
            return out.assign(is_anomaly=False, pending_review=True, reason=f"待复核: {type(error).__name__}")

    return ranked.groupBy("batch_id", "review_batch").applyInPandas(run, "batch_id string, record_index long, field string, value double, seq long, is_anomaly boolean, pending_review boolean, reason string")


def mark_anomalies(df: DataFrame, verdicts: DataFrame, batch: str = "batch_id", index: str = "record_index") -> DataFrame:
    """Each record gets its last verdict that confirms or leaves pending; others are normal. Verdicts on no record are passed over."""
    last = verdicts.where("is_anomaly or pending_review").groupBy(batch, index).agg(F.max_by(F.struct("is_anomaly", "pending_review", "reason", "field", "value"), "seq").alias("_v"))
    pending = F.col("_v.pending_review")
    return df.join(last, [batch, index], "left").withColumns({
        "is_anomaly": F.coalesce(F.col("_v.is_anomaly") & ~pending, F.lit(False)),
        "anomaly_reason": F.when(F.col("_v").isNotNull(), F.col("_v.reason")),
        "anomaly_status": F.when(pending, "pending_review").when(F.col("_v.is_anomaly"), "confirmed").otherwise("normal"),
        "pending_check_fields": F.when(pending, F.struct(F.col("_v.field").alias("field"), F.col("_v.value").alias("value"))),
    }).drop("_v")


def pipeline_log(raw: DataFrame, deduped: DataFrame, missing: DataFrame, ranked: DataFrame, verdicts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """A row for each batch and step: rows in and out, affected, and details as a map."""
    counts = raw.groupBy(batch).agg(F.count("*").alias("n")).join(deduped.groupBy(batch).agg(F.count("*").alias("m")), batch)
    found = ranked.groupBy(batch).agg(F.count("*").alias("candidates"), F.countDistinct("review_batch").alias("batches"))
    said = verdicts.groupBy(batch).agg(F.count_if(F.expr("is_anomaly and not pending_review")).alias("confirmed"), F.countDistinct(F.when(F.col("pending_review"), F.floor((F.col("seq") - 1) / 30))).alias("degraded"))
    wide = counts.join(missing, batch, "left").join(found, batch, "left").join(said, batch, "left").na.fill(0)
    text = lambda *cs: F.create_map(*(x for c in cs for x in (F.lit(c), F.col(c).cast("string"))))
    step = lambda name, a, b, affected, details: F.struct(F.lit(name).alias("step_name"), F.col(a).alias("input_count"), F.col(b).alias("output_count"), affected.alias("affected_count"), details.alias("details"))
    return wide.select(batch, F.explode(F.array(
        step("dedup", "n", "m", F.abs(F.col("n") - F.col("m")), text("n")),
        step("fill_missing", "m", "m", F.abs(F.col("missing_before") - F.col("missing_after")), text("missing_before", "missing_after")),
        step("anomaly_detect", "m", "m", F.col("confirmed"), text("batches", "degraded", "candidates", "confirmed")),
    )).alias("x")).select(batch, "x.*")


def batch_date_range(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """First ~ last date of the first date-like column that has any, else 未知."""
    cols = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]
    dates = [F.coalesce(F.try_to_date(F.substring(F.replace(F.col(c).cast("string"), F.lit("/"), F.lit("-")), 1, 10), "yyyy-MM-dd")) for c in cols]
    ranges = df.groupBy(batch).agg(F.lit(None).cast("string").alias("_none"), *(F.concat_ws(" ~ ", F.min(d).cast("string"), F.max(d).cast("string")).alias(f"_r{i}") for i, d in enumerate(dates)))
    return ranges.select(batch, F.coalesce(*(F.nullif(f"_r{i}", F.lit("")) for i in range(len(cols))), F.lit("未知")).alias("date_range"))


def mark_raw_cleaned(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    done = cleaned.select("batch_id").distinct().withColumn("_done", F.lit(True))
    return raw.join(done, "batch_id", "left").withColumn("status", F.when(F.col("_done"), "cleaned").otherwise(F.col("status"))).drop("_done")


def clean_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows in and out, confirmed anomalies and rows left for review, by batch."""
    counts = cleaned.groupBy("batch_id").agg(F.count("*").alias("output_count"), F.count_if("is_anomaly").alias("anomaly_count"), F.count_if(F.expr("anomaly_status = 'pending_review'")).alias("pending_count"))
    return raw.groupBy("batch_id").agg(F.count("*").alias("input_count")).join(counts, "batch_id", "left").na.fill(0)


def override_anomalies(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id, is_anomaly, reason) by people: status follows the flag, a given reason replaces the old one."""
    edits = edits.select("id", F.col("is_anomaly").alias("_flag"), F.col("reason").alias("_reason"))
    touched = F.col("_flag").isNotNull()
    return records.join(edits, "id", "left").withColumns({
        "is_anomaly": F.coalesce("_flag", "is_anomaly"),
        "anomaly_reason": F.when(touched, F.coalesce("_reason", "anomaly_reason")).otherwise(F.col("anomaly_reason")),
        "anomaly_status": F.when(touched, F.when(F.col("_flag"), "confirmed").otherwise("normal")).otherwise(F.col("anomaly_status")),
        "pending_check_fields": F.when(~touched, F.col("pending_check_fields")),
    }).drop("_flag", "_reason")


def rejudge_pending(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending rows with new verdicts (id, seq, is_anomaly, reason, failed): an anomaly confirms, a failed call stays pending, else normal."""
    new = verdicts.groupBy("id").agg(F.bool_or("failed").alias("_failed"), F.bool_or("is_anomaly").alias("_anomaly"), F.min_by("reason", F.when(F.col("is_anomaly"), F.col("seq"))).alias("_reason"))
    pending, unchecked = F.col("anomaly_status") == "pending_review", F.col("pending_check_fields").isNull()
    state = F.when(~pending, "kept").when(unchecked, "normal").when(F.col("_failed") | F.col("_anomaly").isNull(), "pending").when(F.col("_anomaly"), "confirmed").otherwise("cleared")
    return records.join(new, "id", "left").withColumn("_state", state).withColumns({
        "is_anomaly": F.when(F.col("_state") == "confirmed", True).when(F.col("_state").isin("normal", "cleared"), False).otherwise(F.col("is_anomaly")),
        "anomaly_reason": F.when(F.col("_state") == "confirmed", F.col("_reason")).when(F.col("_state") == "cleared", NOT_ANOMALOUS).otherwise(F.col("anomaly_reason")),
        "anomaly_status": F.when(F.col("_state") == "confirmed", "confirmed").when(F.col("_state").isin("normal", "cleared"), "normal").otherwise(F.col("anomaly_status")),
        "pending_check_fields": F.when(F.col("_state").isin("kept", "pending"), F.col("pending_check_fields")),
        "outcome": F.col("_state"),
    }).drop("_failed", "_anomaly", "_reason", "_state")


def list_anomalies(records: DataFrame, status: str = "confirmed", data_type: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page, newest first, and the total. status: confirmed, pending_review or all."""
    found = records.where(F.col("anomaly_status").isin("confirmed", "pending_review") if status == "all" else F.col("anomaly_status") == status)
    found = found.where(F.col("data_type") == data_type) if data_type else found
    return found.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size), found.agg(F.count("*").alias("total"))


def batch_logs(logs: DataFrame, batch_id: str) -> DataFrame:
    return logs.where(F.col("batch_id") == batch_id).orderBy("created_at")
