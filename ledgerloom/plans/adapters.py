"""The test tables in the roles of business tables: the same rows in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attendance rows in one batch for each event type, with missing hrs and dates."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('att_', event_type) batch_id", "event_id record_index", "cast(user_id as string) `员工编号`",
        "if(event_id % 23 = 0, null, date_format(ts, 'yyyy/MM/dd')) `考勤日期`",
        "if(event_id % 17 = 0, null, value) `加班时长`", "cast(event_id % 9 as double) `迟到次数`",
    )


ATT = """att as (select concat('att_', event_type) batch_id, event_id record_index, cast(user_id as varchar) emp,
 case when event_id % 23 = 0 then null else strftime(ts, '%Y/%m/%d') end dt, case when event_id % 17 = 0 then null else value end hrs,
 cast(event_id % 9 as double) late from events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records of four data types, whose departments, names and dates lie under different payload keys."""
    common = ["id", "batch_id", "source_id", "data_type", "employee_name", "department", "record_date", "quality_score", "is_anomaly", "anomaly_status", "anomaly_reason", "pending_check_fields", "business_data", "created_at"]
    pending = "if({0} % 19 = 0 and {0} % 7 <> 0, named_struct('field', 'v', 'value', cast(1 as double)), null) pending_check_fields"
    state = ["{0} % 7 = 0 is_anomaly", "case when {0} % 7 = 0 then 'confirmed' when {0} % 19 = 0 then 'pending_review' else 'normal' end anomaly_status", "if({0} % 21 = 0, repeat('r', 130), if({0} % 14 = 0, '', if({0} % 7 = 0, 'odd value', null))) anomaly_reason"]
    score = "case when {0} % 11 = 0 then null when {0} % 13 = 0 then 0.0d else ({0} % 100) / 97d end quality_score"
    parts = {
        "events": ("event_id", ["event_id * 4 id", "concat('att_', event_type) batch_id", "1 source_id", "'attendance' data_type", "cast(null as string) employee_name", "cast(null as string) department", "cast(null as date) record_date", "map('员工编号', cast(user_id as string), '所属部门', if(event_id % 29 = 0, ' ', event_type), '考勤日期', date_format(ts, 'yyyy/MM/dd'), '加班时长', cast(value as string)) business_data", "ts created_at"]),
        "orders": ("o_orderkey", ["o_orderkey * 4 + 1 id", "'sales_1' batch_id", "2 source_id", "'sales' data_type", "cast(null as string) employee_name", "cast(null as string) department", "if(o_orderkey % 3 = 0, cast(o_orderdate as date), null) record_date", "map('工号', cast(o_custkey as string), '部门', o_orderpriority, '考勤日期', if(o_orderkey % 5 = 0, 'soon', null), '日期', date_format(o_orderdate, 'yyyy-MM-dd'), '订单金额', cast(o_totalprice as string)) business_data", "o_orderdate created_at"]),
        "customer": ("c_custkey", ["c_custkey * 4 + 2 id", "'cust_1' batch_id", "3 source_id", "'customer' data_type", "if(c_custkey % 2 = 0, c_name, null) employee_name", "if(c_custkey % 5 = 0, 'HQ', null) department", "cast(null as date) record_date", "map('EmployeeID', cast(c_custkey as string), 'Name', c_name, 'Dept', c_mktsegment, 'ContractAmount', cast(c_acctbal as string)) business_data", "timestamp '2024-03-01 00:00:00' created_at"]),
        "part": ("p_partkey", ["p_partkey * 4 + 3 id", "'op_1' batch_id", "4 source_id", "if(p_partkey % 10 = 0, null, 'operation') data_type", "cast(null as string) employee_name", "cast(null as string) department", "cast(null as date) record_date", "map('Metric', p_type, 'Value', cast(p_retailprice as string), 'Target', cast(p_size as string)) business_data", "timestamp '2024-04-01 00:00:00' created_at"]),
    }
    out = None
    for name, (key, columns) in parts.items():
        df = table(spark, sf_dir, name).selectExpr(*columns, score.format(key), pending.format(key), *(s.format(key) for s in state)).select(*common)
        out = df if out is None else out.unionByName(df)
    return out


def _state(key: str) -> str:
    return f"""{key} % 7 = 0 is_anomaly, case when {key} % 7 = 0 then 'confirmed' when {key} % 19 = 0 then 'pending_review' else 'normal' end anomaly_status,
 case when {key} % 21 = 0 then repeat('r', 130) when {key} % 14 = 0 then '' when {key} % 7 = 0 then 'odd value' end anomaly_reason,
 case when {key} % 11 = 0 then null when {key} % 13 = 0 then 0.0 else ({key} % 100) / 97.0::double end quality_score,
 case when {key} % 11 = 0 or {key} % 13 = 0 then 1.0::double when {key} % 100 = 0 then 1.0::double else ({key} % 100) / 97.0::double end q"""


#: rec: the same records, their payload keys as columns (k_dept, k_name, k_date, ...); lookup and report values derived by hand.
REC = f"""rec as (
select event_id * 4 id, concat('att_', event_type) batch_id, 1 source_id, 'attendance' data_type, null::varchar employee_name, null::varchar department, null::date record_date,
 case when event_id % 29 = 0 then ' ' else event_type end k_dept, null::varchar k_name, strftime(ts, '%Y-%m-%d') k_date, value k_value, ts created_at, {_state('event_id')} from events
union all select o_orderkey * 4 + 1, 'sales_1', 2, 'sales', null, null, case when o_orderkey % 3 = 0 then o_orderdate::date end, o_orderpriority, null, strftime(o_orderdate, '%Y-%m-%d'), o_totalprice, o_orderdate, {_state('o_orderkey')} from orders
union all select c_custkey * 4 + 2, 'cust_1', 3, 'customer', case when c_custkey % 2 = 0 then c_name end, case when c_custkey % 5 = 0 then 'HQ' end, null, c_mktsegment, c_name, null, c_acctbal, timestamp '2024-03-01', {_state('c_custkey')} from customer
union all select p_partkey * 4 + 3, 'op_1', 4, case when p_partkey % 10 = 0 then null else 'operation' end, null, null, null, null, null, null, p_retailprice, timestamp '2024-04-01', {_state('p_partkey')} from part),
facts as (select *, coalesce(data_type, 'unknown') type, coalesce(record_date, try_cast(k_date as date)) d, coalesce(department, nullif(trim(k_dept), ''), '未知部门') rdept,
 coalesce(department, k_dept, '') ldept, coalesce(employee_name, k_name, '') lname from rec)"""


def sources(spark: SparkSession) -> DataFrame:
    """The source catalogue (a fixed dimension)."""
    rows = [(1, "考勤系统", "csv", "active", "2024-01-01"), (2, "销售 Sales", "mysql", "error", "2024-01-02"), (3, "customer list", "csv", "active", "2024-01-03"), (4, "其他", "excel", "inactive", "2024-01-03")]
    return spark.createDataFrame(rows, "id int, name string, source_type string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))


SRC = """src(id, name, source_type, status, created_at) as (values (1, '考勤系统', 'csv', 'active', timestamp '2024-01-01'), (2, '销售 Sales', 'mysql', 'error', timestamp '2024-01-02'),
 (3, 'customer list', 'csv', 'active', timestamp '2024-01-03'), (4, '其他', 'excel', 'inactive', timestamp '2024-01-03'))"""
