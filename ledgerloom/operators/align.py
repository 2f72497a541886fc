"""Header alignment: raw headers to standard fields, and mappings applied to payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fields import COMMON_FIELDS, LOOKUP_DATE_KEYS, LOOKUP_DEPARTMENT_KEYS, LOOKUP_NAME_KEYS, TYPE_FIELDS

_KINDS = (("attendance", "考勤"), ("sales", "销售"), ("customer", "客户"), ("operation", "运营"))
FLAG_KEYS = ("is_anomaly", "anomaly_reason", "anomaly_status")


def standard_fields(spark: SparkSession, data_type: str | None = None) -> DataFrame:
    """(field, label) of the common fields and those of the type; all of them for an unknown type."""
    own = [TYPE_FIELDS[data_type]] if data_type in TYPE_FIELDS else list(TYPE_FIELDS.values())
    fields: dict[str, str] = dict(COMMON_FIELDS)
    for f in own:
        fields.update(f)
    return spark.createDataFrame(list(fields.items()), "field string, label string")


def normal_header(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[\s_（）()]+", ""))


def synonyms(spark: SparkSession) -> DataFrame:
    """(header, field): labels, field names and the known variants of department, name and date headers."""
    fields = {**COMMON_FIELDS, **{k: v for f in TYPE_FIELDS.values() for k, v in f.items()}}
    rows = [(h, f) for f, label in fields.items() for h in (f, label)]
    rows += [(h, f) for f, keys in (("department", LOOKUP_DEPARTMENT_KEYS), ("employee_name", LOOKUP_NAME_KEYS), ("record_date", LOOKUP_DATE_KEYS), ("employee_id", ("员工编号", "工号", "EmployeeID"))) for h in keys]
    base = spark.createDataFrame(rows, "header string, field string").select(normal_header(F.col("header")).alias("header"), "field")
    return base.groupBy("header").agg(F.min("field").alias("field"))


def align_headers(headers: DataFrame, known: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """headers (source_id, pos, header) against ``known`` (header, field): mapping, unmapped headers, confidence.

    Of two headers that want one field the first gets it. ``fields`` restricts the fields to a type's.
    """
    known = known.join(fields.select("field"), "field", "left_semi") if fields is not None else known
    tried = headers.withColumn("_h", normal_header(F.col("header"))).join(known.withColumnRenamed("header", "_h"), "_h", "left")
    rank = F.row_number().over(Window.partitionBy("source_id", "field").orderBy("pos"))
    hit = (F.col("field").isNotNull()) & (rank == 1)
    rows = tried.withColumn("_hit", hit).groupBy("source_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.struct("header", "field"))))).alias("mapping"),
        F.array_sort(F.collect_list(F.when(~F.col("_hit"), F.struct("pos", "header")))).alias("_rest"),
        F.round(F.count_if("_hit") / F.count("*"), 4).alias("confidence"),
    )
    return rows.select("source_id", "mapping", F.transform("_rest", lambda x: x["header"]).alias("unmapped"), "confidence")


def parse_mapping_json(c: Column) -> Column:
    """An aligner's answer: mapping under either key, unmapped or [], confidence or 0.5."""
    from .routing import parse_model_json

    r = parse_model_json(c, "mapping map<string,string>, mappings map<string,string>, unmapped array<string>, confidence double")
    return F.when(r.isNotNull(), F.struct(F.coalesce(r["mapping"], r["mappings"], F.expr("cast(map() as map<string,string>)")).alias("mapping"), F.coalesce(r["unmapped"], F.expr("cast(array() as array<string>)")).alias("unmapped"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence")))


def latest_mapping(mappings: DataFrame) -> DataFrame:
    """The newest mapping of each source (the larger id among equals)."""
    return mappings.groupBy("source_id").agg(F.max_by(F.struct(*mappings.columns), F.struct("created_at", "id")).alias("m")).select("m.*")


def assert_reviewed(mappings: DataFrame) -> DataFrame:
    """The newest mappings, if each is reviewed; else an error names some that are not."""
    newest = latest_mapping(mappings)
    waiting = [r.source_id for r in newest.where("not coalesce(manual_reviewed, false)").select("source_id").orderBy("source_id").limit(10).collect()]
    if waiting:
        raise ValueError(f"mappings of sources {waiting} are not reviewed")
    return newest


def review_mapping(mappings: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    return mappings.join(done, "id", "left").withColumn("manual_reviewed", F.coalesce("_done", "manual_reviewed")).drop("_done")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def infer_data_type(name: Column) -> Column:
    low, out = F.lower(name), F.lit("")
    for kind, word in reversed(_KINDS):
        out = F.when(low.contains(word) | low.contains(kind), kind).otherwise(out)
    return out


def apply_mapping(df: DataFrame, mappings: DataFrame, payload: str = "raw_data") -> DataFrame:
    """Payload under standard names: with a mapping only its keys, without one all non-null keys but flags."""
    joined = df.join(mappings.select("source_id", F.col("mapping_data").alias("_m")), "source_id", "left")
    mapped = F.transform_keys(F.map_filter(payload, lambda k, v: F.map_contains_key(F.col("_m"), k)), lambda k, v: F.col("_m").getItem(k))
    plain = F.map_filter(payload, lambda k, v: v.isNotNull() & ~k.isin(*FLAG_KEYS))
    return joined.withColumn("business_data", F.when(F.size("_m") > 0, mapped).otherwise(plain)).drop("_m")


def probe_source(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn("columns", F.array(*(F.lit(c) for c in df.columns)))


def build_cleaned(raw: DataFrame, mappings: DataFrame, types: DataFrame) -> DataFrame:
    """Cleaned records of raw rows: standard columns come from the mapped payload. types: (source_id, data_type)."""
    mapped = apply_mapping(raw, mappings).join(types, "source_id", "left")
    text = lambda k: F.nullif(F.trim(F.col("business_data").getItem(k)), F.lit("")).alias(k)
    day = F.try_to_date(F.substring(F.replace(F.col("business_data").getItem("record_date"), F.lit("/"), F.lit("-")), 1, 10), "yyyy-MM-dd")
    return mapped.select("batch_id", "source_id", "source_row_index", "data_type", text("employee_name"), text("employee_id"), text("department"), day.alias("record_date"), "business_data")
