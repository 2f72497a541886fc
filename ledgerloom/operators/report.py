"""Reports over cleaned records and collected batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import percent, quality, report_date, report_department


def _facts(records: DataFrame) -> DataFrame:
    return records.select(F.coalesce("data_type", F.lit("unknown")).alias("data_type"), report_date().alias("date"), report_department().alias("department"), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), quality().alias("quality"), "batch_id")


def _measures() -> list[Column]:
    n, bad = F.count("*"), F.count_if("is_anomaly")
    return [n.alias("count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), bad.alias("anomaly_count"), percent(bad, n).alias("anomaly_rate"), F.round(F.avg("quality"), 4).alias("avg_quality")]


def summary_by_type(records: DataFrame) -> DataFrame:
    return _facts(records).groupBy("data_type").agg(*_measures())


def summary_total(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.countDistinct("batch_id").alias("batches"))


def trend(records: DataFrame, metric: str = "count", data_type: str | None = None, granularity: str = "month") -> DataFrame:
    """Count or anomaly percentage for each period and type; rows without a date are left out."""
    facts = _facts(records).where("date is not null")
    facts = facts.where(F.col("data_type") == data_type) if data_type else facts
    n = F.count("*")
    value = n.cast("double") if metric == "count" else percent(F.count_if("is_anomaly"), n)
    return facts.groupBy(F.date_format("date", "yyyy-MM" if granularity == "month" else "yyyy-MM-dd").alias("period"), "data_type").agg(value.alias("value")).orderBy("period", "data_type")


def quality_report(records: DataFrame) -> DataFrame:
    """By department, with the overall row named 全部; missing_rate is not known here and 0 (see clean.missing_stats)."""
    n, bad = F.count("*"), F.count_if("is_anomaly")
    out = _facts(records).rollup("department").agg(F.grouping("department").alias("g"), n.alias("total"), bad.alias("anomalies"), percent(bad, n).alias("anomaly_rate"), F.round(F.avg("quality"), 4).alias("avg_quality"))
    return out.select(F.when(F.col("g") == 1, "全部").otherwise(F.col("department")).alias("department"), "total", "anomalies", "anomaly_rate", "avg_quality", F.lit(0.0).alias("missing_rate"))


def dashboard(records: DataFrame) -> DataFrame:
    """Totals by type, by type and month, and by department, from one scan."""
    facts = _facts(records).withColumn("period", F.date_format("date", "yyyy-MM"))
    n, bad = F.count("*"), F.count_if("is_anomaly")
    t, p, d = F.col("data_type"), F.col("period"), F.col("department")
    out = facts.groupingSets([[], [t], [t, p], [d]], "data_type", "period", "department").agg(F.grouping_id().alias("g"), n.alias("count"), bad.alias("anomaly_count"), percent(bad, n).alias("anomaly_rate"), F.round(F.avg("quality"), 4).alias("avg_quality"))
    return out.where("g <> 1 or period is not null").selectExpr("case g when 7 then 'all' when 3 then 'type' when 1 then 'trend' else 'department' end section", "data_type", "period", "department", "count", "anomaly_count", "anomaly_rate", "avg_quality")


def trend_pivot(points: DataFrame, types: list[str]) -> DataFrame:
    """All periods by the given types; absent cells are null."""
    return points.groupBy("period").pivot("data_type", types).agg(F.first("value"))


def anomaly_rate_report(records: DataFrame) -> DataFrame:
    """Anomaly percentage for each department and data type."""
    n, bad = F.count("*"), F.count_if("is_anomaly")
    return _facts(records).groupBy("department", "data_type").agg(n.alias("total"), bad.alias("anomalies"), percent(bad, n).alias("anomaly_rate"))


def collect_history(raw: DataFrame, sources: DataFrame, source_id: int | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """Batches, newest first, with their rows, first time, least status and source."""
    rows = raw.where(F.col("source_id") == source_id) if source_id is not None else raw
    groups = rows.groupBy("batch_id", "source_id").agg(F.count("*").alias("count"), F.min("created_at").alias("collected_at"), F.min("status").alias("status"))
    named = groups.join(sources.selectExpr("id source_id", "name source_name", "source_type"), "source_id", "left")
    return named.orderBy(F.desc("collected_at"), "batch_id", "source_id").offset((page - 1) * size).limit(size)


def batch_detail(raw: DataFrame, sources: DataFrame, batch_id: str, limit: int = 100) -> DataFrame:
    """The first rows of a batch by their place in the source, with the batch's total and source."""
    own = raw.where(F.col("batch_id") == batch_id)
    top = own.orderBy("source_row_index", "id").limit(limit).crossJoin(own.agg(F.count("*").alias("total")))
    return top.join(sources.selectExpr("id source_id", "name source_name", "source_type"), "source_id", "left")


def source_overview(sources: DataFrame, source_type: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts by status, and a page of sources, newest first."""
    counts = sources.agg(F.count("*").alias("total"), F.count_if(F.expr("status = 'active'")).alias("active"), F.count_if(F.expr("status = 'error'")).alias("error"))
    rows = sources.where(F.col("source_type") == source_type) if source_type else sources
    return counts, rows.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
