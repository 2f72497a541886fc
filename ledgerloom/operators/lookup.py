"""Lookups in cleaned records: filters over columns and payload keys, totals and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import LOOKUP_DATE_KEYS, LOOKUP_DEPARTMENT_KEYS, LOOKUP_NAME_KEYS, lookup_date, lookup_department, payload, percent, quality, record_name


def department_is(value: str) -> Column:
    """The column or any known key equals the value."""
    return _any(F.col("department") == value, *(payload(k) == value for k in LOOKUP_DEPARTMENT_KEYS))


def name_is(value: str) -> Column:
    return _any(F.col("employee_name") == value, *(payload(k) == value for k in LOOKUP_NAME_KEYS))


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def date_between(start: str | None, end: str | None) -> Column:
    """Some candidate date lies in the whole range; dates compare as ISO text."""
    dates = [F.date_format("record_date", "yyyy-MM-dd"), *(F.replace(payload(k), F.lit("/"), F.lit("-")) for k in LOOKUP_DATE_KEYS)]
    inside = lambda d: (d >= start if start else d.isNotNull()) & (d <= end if end else F.lit(True))
    return _any(*(inside(d) for d in dates))


def filtered(records: DataFrame, data_type: str | None = None, department: str | None = None, name: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    out = records.where(F.col("data_type") == data_type) if data_type else records
    out = out.where(department_is(department)) if department else out
    out = out.where(name_is(name)) if name else out
    return out.where(date_between(start, end)) if start or end else out


def payload_preview(n: int = 5) -> Column:
    """The first n payload items as ``k=v，...``."""
    return F.array_join(F.transform(F.slice(F.map_entries("business_data"), 1, n), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "，")


def query_records(records: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """The first rows by id with their department, name, date and preview, and the number of all that match."""
    found = filtered(records, **filters)
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy("id").limit(limit).select("id", "data_type", lookup_department().alias("department"), record_name().alias("employee_name"), lookup_date().alias("record_date"), payload_preview().alias("preview"))
    return top.crossJoin(total)


def summary_stats(records: DataFrame, data_type: str | None = None) -> DataFrame:
    """Total, anomalies, their percentage and mean quality: overall, by type and by department, from one scan."""
    base = filtered(records, data_type).select(F.coalesce("data_type", F.lit("unknown")).alias("type"), lookup_department().alias("dept"), "is_anomaly", quality().alias("q"))
    n, bad = F.count("*"), F.count_if("is_anomaly")
    grouped = base.groupingSets([[], [F.col("type")], [F.col("dept")]], "type", "dept").agg(F.grouping_id().alias("g"), n.alias("total"), bad.alias("anomalies"), percent(bad, n).alias("anomaly_rate"), F.round(F.avg("q"), 4).alias("avg_quality"))
    return grouped.selectExpr("case g when 3 then 'all' when 1 then 'type' else 'department' end scope", "case g when 3 then '' when 1 then type else dept end name", "total", "anomalies", "anomaly_rate", "avg_quality")


def anomaly_details(records: DataFrame, limit: int = 10, default: str = "未说明", **filters) -> DataFrame:
    """Anomalies by id with their reason, cut at 120 characters."""
    reason = F.coalesce(F.nullif("anomaly_reason", F.lit("")), F.lit(default))
    return filtered(records, **filters).where("is_anomaly").orderBy("id").limit(limit).select("id", "data_type", lookup_department().alias("department"), record_name().alias("employee_name"), F.when(F.length(reason) > 120, F.concat(F.substring(reason, 1, 120), F.lit("..."))).otherwise(reason).alias("reason"))


def payload_number(key: str) -> Column:
    return F.expr(f"try_cast(business_data['{key}'] as double)")


def payload_gt(key: str, threshold: float) -> Column:
    return payload_number(key) > threshold


def stale_days(as_of: str, key: str) -> Column:
    """Days from a payload date to ``as_of``."""
    return F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(F.replace(payload(key), F.lit("/"), F.lit("-")), 1, 10), "yyyy-MM-dd"))


def rank_groups(records: DataFrame, group: Column, measure: Column) -> DataFrame:
    """Groups by the sum of a measure, ranked with ties; the ranked rows are as many as the groups."""
    sums = records.groupBy(group.alias("group")).agg(F.round(F.sum(measure), 4).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("total"))))
