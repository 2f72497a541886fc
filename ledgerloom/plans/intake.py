"""Queries of sources, landing, headers and export, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import align
from ..sources import landing, readers
from .adapters import REC, records, sources, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("read_csv_source", "select o_orderkey, o_orderpriority, round(o_totalprice, 2) o_totalprice from orders")
def _csv(s, d):
    path = scratch(s)
    table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice")).write.csv(path, header=True, sep=";")
    return readers.read_csv_source(s, path, ";", schema="o_orderkey long, o_orderpriority string, o_totalprice double")


@query("read_csv_skip_rows", "select cast(c_custkey as varchar) \"编号\", c_name \"姓名\" from customer")
def _skip(s, d):
    """Files of some hundred lines with two lines above the header, as departments send them."""
    path = scratch(s)
    part = F.floor(F.col("c_custkey") / 500)
    lines = table(s, d, "customer").groupBy(part.alias("p")).agg(F.concat(F.lit("客户报表\n制表人,某某\n编号,姓名\n"), F.array_join(F.collect_list(F.concat_ws(",", "c_custkey", "c_name")), "\n")).alias("value"))
    lines.select("p", "value").write.partitionBy("p").option("lineSep", "\n\n\n").text(path)
    return readers.read_csv_source(s, path, skip_rows=2)


@query("read_documents", "select concat('doc_', doc_id, '.md') file_name, length(text) n, md5(text) h from documents where text <> ''")
def _docs(s, d):
    """Each document as a Markdown file in folders of about 2,000, beside an index and a file of another kind, which are passed over."""
    path, rows = scratch(s), table(s, d, "documents")
    docs, folders = rows.where("text <> ''"), rows.count() // 2000 + 1
    others = s.createDataFrame([("INDEX.md", "index"), ("notes.txt", "notes")], "file_name string, text string")
    landing.write_documents(docs.selectExpr("concat('doc_', doc_id, '.md') file_name", "text").union(others), path, folders)
    return readers.read_documents(s, path, depth=1).selectExpr("file_name", "length(text) n", "md5(text) h")


@query("read_jdbc_source", "select c_custkey, c_name, c_nationkey from customer")
def _jdbc(s, d):
    """Customers through an embedded database, read in parts by key."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey").write.format("jdbc").option("url", url).options(**driver).option("dbtable", "customer").save()
    return readers.read_jdbc_source(s, url, 'select "c_custkey", "c_name", "c_nationkey" from customer', driver, ("c_custkey", 0, 20_000, 4))


query("land_raw", "select 2 source_id, 'batch_1_2' batch_id, o_orderkey source_row_index, cast(o_custkey as varchar) cust, o_orderpriority prio, 'raw' status from orders")(
    lambda s, d: landing.land_raw(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), 2, "batch_1_2", "o_orderkey").selectExpr("source_id", "batch_id", "source_row_index", "raw_data['o_custkey'] cust", "raw_data['o_orderpriority'] prio", "status")
)


@query("land_raw_numbered", "select row_number() over (order by o_orderkey) - 1 source_row_index, cast(o_orderkey as varchar) k from orders")
def _numbered(s, d):
    """A source of several files, numbered in the order of the files and of their rows."""
    path = scratch(s)
    table(s, d, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(path, header=True)
    return landing.land_raw(readers.read_csv_source(s, path, schema="o_orderkey long, o_orderpriority string"), 3, "batch_1_3").selectExpr("source_row_index", "raw_data['o_orderkey'] k")


@query("collect_batch", "select 1 source_id, 'active' status, (select count(*) from orders) as rows, false failed union all select 2, 'error', 0, true union all select 3, 'active', (select count(*) from customer), false union all select 4, 'error', 0, true")
def _collect(s, d):
    jobs = [{"id": 1, "source_type": "parquet", "path": f"{d}/orders.parquet"}, {"id": 2, "source_type": "parquet", "path": f"{d}/absent.parquet"}, {"id": 3, "source_type": "parquet", "path": f"{d}/customer.parquet"}, {"id": 4, "source_type": "xlsx", "path": "x"}]
    path = scratch(s)
    return landing.collect_batch(s, jobs, readers.load_source, lambda df, batch: df.drop("batch_id").write.parquet(f"{path}/batch_id={batch}"), "20240101").select("source_id", "status", "rows", F.col("message").isNotNull().alias("failed"))


query("collect_totals", "select 4::bigint sources, 2::bigint succeeded, (select count(*) from orders) + (select count(*) from customer) as rows")(lambda s, d: landing.collect_totals(QUERIES["collect_batch"](s, d)))
query("update_source_status", "select 1 id, 'active' status, (select count(*) from orders) last_collect_count union all select 2, 'error', null union all select 3, 'active', (select count(*) from customer) union all select 4, 'error', null")(
    lambda s, d: landing.update_source_status(sources(s), QUERIES["collect_batch"](s, d).withColumn("message", F.lit("m")), "2024-05-01").select("id", "status", "last_collect_count")
)
query("validate_source", "select 'orders' name, true ok union all select 'empty', false union all select 'one', false")(
    lambda s, d: s.createDataFrame([(n, readers.validate_source(df)[0]) for n, df in (("orders", table(s, d, "orders")), ("empty", table(s, d, "orders").where("o_orderkey < 0")), ("one", table(s, d, "orders").select("o_orderkey")))], "name string, ok boolean")
)

_LINE = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' intent_route | q_hash=', substr(sha2(cast(user_id as string), 256), 1, 16), ' | intent=', event_type, ' | p_top=', cast(cast(event_id % 100 as decimal(10,4)) / 100 as decimal(10,4)), ' | label_mass=1.0000 | margin=0.5000 | latency_ms=', event_id % 500, '.0 | path=', if(event_id % 4 = 0, 'rule', 'logprobs'), ' | degrade=- | top5={\"a\": -0.1}') value"
query("parse_route_log", "select date_trunc('second', ts) logged_at, substr(sha256(cast(user_id as varchar)), 1, 16) q_hash, event_type intent, (event_id % 100) / 100.0::double p_top, 1.0::double label_mass, 0.5::double margin, (event_id % 500)::double latency_ms, -0.1::double a from events where event_id % 4 <> 0")(
    lambda s, d: readers.parse_route_log(table(s, d, "events").selectExpr(_LINE)).selectExpr("logged_at", "q_hash", "intent", "p_top", "label_mass", "margin", "latency_ms", "top5['a'] a")
)


@query("read_eval_dataset", "select event_id id, concat('q', user_id) question, event_type expected_intent, concat('original_', event_id) source from events")
def _eval(s, d):
    path = scratch(s)
    table(s, d, "events").selectExpr("event_id id", "concat('q', user_id) question", "event_type expected_intent", "concat('original_', event_id) source").groupBy(F.expr("id div 2000").alias("p")).agg(F.to_json(F.collect_list(F.struct("id", "question", "expected_intent", "source"))).alias("value")).write.partitionBy("p").text(path)
    return readers.read_eval_dataset(s, path).select("id", "question", "expected_intent", "source")


@query("read_eval_report", "select event_id id, event_type predicted from events")
def _report(s, d):
    path = scratch(s)
    table(s, d, "events").groupBy(F.expr("event_id div 2000").alias("meta")).agg(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("predicted"))).alias("intent")).select("meta", F.to_json(F.struct("intent")).alias("value")).write.partitionBy("meta").text(path)
    return readers.read_eval_report(s, path, "intent").select("id", "predicted")


query("latest_report", "select max(strftime(ts, '%Y%m%d_%H%M%S')) stamp from events where event_id % 3 = 0")(
    lambda s, d: s.createDataFrame([(readers.latest_report(table(s, d, "events").selectExpr("concat('out/', if(event_id % 3 = 0, 'eval_report_', 'other_'), date_format(ts, 'yyyyMMdd_HHmmss'), '.json') path")).stamp,)], "stamp string")
)
query("export_wide", f"""with {REC} select id, data_type, department, record_date, case when is_anomaly then '是' else '否' end is_anomaly, k_dept "业务_部门", k_date "业务_日期" from facts where data_type = 'sales' and record_date >= date '1996-01-01' and record_date <= date '1997-12-31'""")(
    lambda s, d: landing.export_wide(records(s, d), ["sales"], "1996-01-01", "1997-12-31").select("id", "data_type", "department", "record_date", "is_anomaly", "业务_部门", "业务_日期")
)

# headers: each event type is a source that sends a header for each of its users
_HEADS = "case user_id % 9 when 0 then '所属部门' when 1 then ' Name ' when 2 then '日期' when 3 then 'Order_Amount' when 4 then '订单金额' when 5 then '考勤日期' when 6 then 'EmployeeID' when 7 then '备注' else 'x' end"


def _headers(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("source_id"), F.expr(_HEADS).alias("header")).agg(F.min("event_id").alias("pos"))


query("align_headers", f"""with h as (select event_type source_id, {_HEADS} header, min(event_id) pos from events group by 1, 2),
 t as (select *, case trim(header) when '所属部门' then 'department' when 'Name' then 'employee_name' when '日期' then 'record_date' when '考勤日期' then 'record_date' when 'EmployeeID' then 'employee_id' when 'Order_Amount' then 'order_amount' when '订单金额' then 'order_amount' end field from h),
 r as (select *, field is not null and row_number() over (partition by source_id, field order by pos) = 1 hit from t)
 select source_id, count(*) filter (hit) mapped, string_agg(header, ',' order by pos) filter (not hit) unmapped, round(count(*) filter (hit) / count(*), 4) confidence,
 case when count(*) filter (hit) / count(*) >= 0.9 then 'high' when count(*) filter (hit) / count(*) >= 0.7 then 'medium' else 'low' end band from r group by 1""")(
    lambda s, d: align.align_headers(_headers(s, d), align.synonyms(s)).select("source_id", F.size("mapping").cast("long").alias("mapped"), F.array_join("unmapped", ",").alias("unmapped"), "confidence", align.confidence_band(F.col("confidence")).alias("band"))
)
# each event carries one header, of which the type that its user belongs to knows some
_FIELD = "case event_id % 6 when 0 then 'overtime_hours' when 1 then 'order_amount' when 2 then 'customer_name' when 3 then 'metric_value' when 4 then 'department' else 'other' end"
_KIND = "case user_id % 5 when 0 then 'attendance' when 1 then 'sales' when 2 then 'customer' when 3 then 'operation' else 'unknown' end"


@query("standard_fields", f"""with e as (select {_KIND} kind, {_FIELD} field from events) select kind, field, count(*) n from e
 where field = 'department' or kind = 'attendance' and field = 'overtime_hours' or kind = 'sales' and field in ('order_amount', 'customer_name') or kind = 'customer' and field = 'customer_name' or kind = 'operation' and field = 'metric_value' or kind = 'unknown' and field <> 'other' group by 1, 2""")
def _standard(s, d):
    known = None
    for kind in ("attendance", "sales", "customer", "operation", "unknown"):
        own = align.standard_fields(s, kind).select(F.lit(kind).alias("kind"), "field")
        known = own if known is None else known.union(own)
    return table(s, d, "events").selectExpr(f"{_KIND} kind", f"{_FIELD} field").join(known, ["kind", "field"]).groupBy("kind", "field").agg(F.count("*").alias("n"))


_MAPS = ["event_id id", "user_id source_id", "map('a', event_type) mapping_data", "event_id % 3 = 0 manual_reviewed", "ts created_at"]
query("latest_mapping", "select source_id, id, manual_reviewed from (select user_id source_id, event_id id, event_id % 3 = 0 manual_reviewed, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")(
    lambda s, d: align.latest_mapping(table(s, d, "events").selectExpr(*_MAPS)).select("source_id", "id", "manual_reviewed")
)
@query("assert_reviewed_blocks", "select count(*) filter (not ok) > 0 blocked, count(*) sources from (select user_id, max_by(event_id % 3 = 0, ts) ok from events group by 1)")
def _blocks(s, d):
    """All mappings, of which many are not reviewed, so the batch does not go on."""
    maps = table(s, d, "events").selectExpr(*_MAPS)
    try:
        align.assert_reviewed(maps)
        blocked = False
    except ValueError:
        blocked = True
    return align.latest_mapping(maps).agg(F.lit(blocked).alias("blocked"), F.count("*").alias("sources"))


query("assert_reviewed", "select user_id source_id, max_by(event_id, ts) id from events where event_id % 3 = 0 group by 1")(lambda s, d: align.assert_reviewed(table(s, d, "events").where("event_id % 3 = 0").selectExpr(*_MAPS)).select("source_id", "id"))
query("review_mapping", "select event_id id, event_id % 3 = 0 or event_id % 5 = 0 manual_reviewed from events")(
    lambda s, d: align.review_mapping(table(s, d, "events").selectExpr(*_MAPS), table(s, d, "events").where("event_id % 5 = 0").selectExpr("event_id id")).select("id", "manual_reviewed")
)
query("infer_data_type", "select p_type, case when contains(lower(p_type), 'customer') then 'customer' when p_size % 5 = 0 then 'attendance' when p_size % 5 = 1 then 'sales' when p_size % 5 = 2 then 'operation' else '' end kind, count(*) n from part group by 1, 2")(
    lambda s, d: table(s, d, "part").select("p_type", align.infer_data_type(F.expr("concat(p_type, case p_size % 5 when 0 then ' 考勤 Sales' when 1 then ' SALES' when 2 then '运营' else '' end)")).alias("kind")).groupBy("p_type", "kind").agg(F.count("*").alias("n"))
)
_RAW = ["o_orderkey", "cast(o_orderkey % 2 as int) source_id", "map('部门', o_orderpriority, '日期', date_format(o_orderdate, 'yyyy/MM/dd'), '备注', if(o_orderkey % 4 = 0, null, 'n'), 'is_anomaly', 'x') raw_data", "'b' batch_id", "o_orderkey source_row_index"]


def _mapping(s):
    return s.sql("select 1 source_id, map('部门', 'department', '日期', 'record_date') mapping_data")


query("apply_mapping", "select o_orderkey, case when o_orderkey % 2 = 1 then 'department,record_date' when o_orderkey % 4 = 0 then '日期,部门' else '备注,日期,部门' end keys, o_orderpriority dept from orders")(
    lambda s, d: align.apply_mapping(table(s, d, "orders").selectExpr(*_RAW), _mapping(s)).selectExpr("o_orderkey", "array_join(array_sort(map_keys(business_data)), ',') keys", "coalesce(business_data['department'], business_data['部门']) dept")
)
query("build_cleaned", "select o_orderkey source_row_index, case when o_orderkey % 2 = 1 then o_orderpriority end department, case when o_orderkey % 2 = 1 then o_orderdate::date end record_date, case when o_orderkey % 2 = 1 then 'sales' end data_type from orders")(
    lambda s, d: align.build_cleaned(table(s, d, "orders").selectExpr(*_RAW), _mapping(s), s.sql("select 1 source_id, 'sales' data_type")).select("source_row_index", "department", "record_date", "data_type")
)
query("parse_mapping_json", "select event_id, case when event_id % 4 = 3 then null when event_id % 4 = 2 then 0 else 1 end mapped, case when event_id % 4 = 3 then null when event_id % 4 = 0 then 0.9 else 0.5 end::double confidence from events")(
    lambda s, d: table(s, d, "events").select("event_id", align.parse_mapping_json(F.expr("""case event_id % 4 when 0 then '```json\n{"mapping": {"a": "b"}, "confidence": 0.9}\n```' when 1 then 'Sure: {"mappings": {"a": "b"}, "unmapped": ["c"]} ok' when 2 then '{}' else 'none' end""")).alias("m")).selectExpr("event_id", "cast(size(m.mapping) as int) mapped", "m.confidence confidence").withColumn("mapped", F.when(F.col("confidence").isNotNull(), F.col("mapped")))
)
query("probe_source", "select count(*) row_count, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' \"columns\" from part")(lambda s, d: align.probe_source(table(s, d, "part")).withColumn("columns", F.array_join("columns", ",")))
