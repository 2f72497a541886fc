"""Queries of cleaning, lookup and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, lookup, report
from ..functions.fields import lookup_department
from .adapters import ATT, REC, SRC, attendance, records, sources, table

NUM, CAT = ["加班时长", "迟到次数"], ["员工编号", "考勤日期"]
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


_DEDUP = f"{ATT}, dd as (select * from (select *, row_number() over (partition by batch_id, emp, dt order by record_index) rn from att) where rn = 1)"
_FILL = f"""{_DEDUP}, med as (select batch_id, median(hrs) mh, median(late) ml from dd group by 1),
 md as (select batch_id, dt from (select batch_id, dt, row_number() over (partition by batch_id order by count(*) desc, dt) rn from dd where dt is not null group by 1, 2) where rn = 1),
 ff as (select dd.batch_id, record_index, emp, coalesce(dd.dt, md.dt) dt, coalesce(hrs, mh) hrs, coalesce(late, ml) late from dd join med using (batch_id) join md using (batch_id))"""
_IQR = f"""{_FILL}, qq as (select batch_id, quantile_cont(hrs, 0.25) a, median(hrs) m, quantile_cont(hrs, 0.75) b, quantile_cont(late, 0.25) a2, median(late) m2, quantile_cont(late, 0.75) b2 from ff group by 1),
 cand as (select batch_id, record_index, '加班时长' field, 0 col_pos, hrs as value, a q1, b q3, b - a iqr, round(abs(hrs - m) / (b - a), 2) deviation from ff join qq using (batch_id) where b > a and (hrs < a - 1.5 * (b - a) or hrs > b + 1.5 * (b - a))
 union all select batch_id, record_index, '迟到次数', 1, late, a2, b2, b2 - a2, round(abs(late - m2) / (b2 - a2), 2) from ff join qq using (batch_id) where b2 > a2 and (late < a2 - 1.5 * (b2 - a2) or late > b2 + 1.5 * (b2 - a2))),
 rk as (select *, row_number() over (partition by batch_id order by deviation desc, col_pos, record_index) rank from cand)"""


def _deduped(s, d):
    return clean.dedup_keep_first(attendance(s, d), ["员工编号", "考勤日期"], "record_index")


def _filled(s, d):
    return clean.fill_missing(_deduped(s, d), NUM, CAT)


def _ranked(s, d):
    return clean.rank_candidates(clean.iqr_candidates(_filled(s, d), NUM))


def _verdicts(s, d) -> DataFrame:
    """Every candidate judged by its rank: most confirmed, some pending, some cleared."""
    return _ranked(s, d).selectExpr("batch_id", "cast(rank as long) seq", "record_index", "field", "value", "rank % 5 <> 0 and rank % 7 <> 0 is_anomaly", "rank % 7 = 0 pending_review", "concat(field, '=', cast(rank as string)) reason")


_VERD = f"{_IQR}, vd as (select batch_id, rank seq, record_index, field, value, rank % 5 <> 0 and rank % 7 <> 0 is_anomaly, rank % 7 = 0 pending_review, concat(field, '=', rank::varchar) reason from rk)"
_MARK = f"""{_VERD}, lastv as (select * from (select *, row_number() over (partition by batch_id, record_index order by seq desc) rn from vd where is_anomaly or pending_review) where rn = 1),
 mk as (select ff.batch_id, ff.record_index, coalesce(is_anomaly and not pending_review, false) is_anomaly, case when pending_review then 'pending_review' when is_anomaly then 'confirmed' else 'normal' end anomaly_status, reason anomaly_reason
 from ff left join lastv using (batch_id, record_index))"""

query("find_key_columns", "select min(o_orderkey) o_orderkey, o_orderdate from orders group by o_orderdate")(
    lambda s, d: clean.dedup_keep_first(table(s, d, "orders"), clean.find_key_columns(table(s, d, "orders").columns), "o_orderkey").select("o_orderkey", "o_orderdate")
)
query("dedup_keep_first", f"with {_DEDUP} select batch_id, record_index, emp \"员工编号\", dt \"考勤日期\", hrs \"加班时长\", late \"迟到次数\" from dd")(_deduped)
query("dedup_lineitem", "select l_orderkey, l_linenumber, max(l_extendedprice) l_extendedprice, count(*) n from lineitem group by 1, 2")(
    lambda s, d: clean.dedup_keep_first(table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", "-l_extendedprice ord", "count(*) over (partition by l_orderkey, l_linenumber) n"), ["l_orderkey", "l_linenumber"], "ord").drop("ord")
)
query("fill_missing", f"with {_FILL} select batch_id, record_index, emp \"员工编号\", dt \"考勤日期\", hrs \"加班时长\", late \"迟到次数\" from ff")(_filled)
query("missing_stats", f"""with {_FILL}, b as (select batch_id, count(*) as rows, sum((emp is null)::int + (dt is null)::int + (hrs is null)::int + (late is null)::int) missing_before from dd group by 1)
 select batch_id, missing_before::bigint missing_before, rows, 0::bigint missing_after, missing_before / (rows * 4.0::double) missing_rate from b""")(
    lambda s, d: clean.missing_stats(_deduped(s, d), _filled(s, d), NUM + CAT)
)
query("iqr_candidates", f"with {_IQR} select batch_id, record_index, field, col_pos, round(value, 6) as value, round(q1, 6) q1, round(q3, 6) q3, round(iqr, 6) iqr, deviation from cand")(
    lambda s, d: clean.iqr_candidates(_filled(s, d), NUM).selectExpr("batch_id", "record_index", "field", "col_pos", "round(value, 6) value", "round(q1, 6) q1", "round(q3, 6) q3", "round(iqr, 6) iqr", "deviation")
)
# powers of prices, so that large ones stand out
query("iqr_orders", """with o as (select o_orderpriority p, o_orderkey, (o_totalprice * o_totalprice / 1000000) * (o_totalprice * o_totalprice / 1000000) v from orders), q as (select quantile_cont(v, 0.25) a, median(v) m, quantile_cont(v, 0.75) b, p from o group by p)
 select p batch_id, o_orderkey record_index, 'v' field, 0 col_pos, v as value, round(a, 4) q1, round(b, 4) q3, round(b - a, 4) iqr, round(abs(v - m) / (b - a), 2) deviation from o join q using (p) where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a)""")(
    lambda s, d: clean.iqr_candidates(table(s, d, "orders").selectExpr("o_orderpriority batch_id", "o_orderkey record_index", "(o_totalprice * o_totalprice / 1000000) * (o_totalprice * o_totalprice / 1000000) v"), ["v"]).selectExpr("batch_id", "record_index", "field", "col_pos", "value", "round(q1, 4) q1", "round(q3, 4) q3", "round(iqr, 4) iqr", "deviation")
)
query("review_batches", f"with {_IQR} select batch_id, record_index, field, rank, (rank - 1) // 30 review_batch, case when deviation >= 3 then 'extreme' when deviation >= 2 then 'high' when deviation >= 1.5 then 'medium' else 'low' end severity from rk")(
    lambda s, d: _ranked(s, d).select("batch_id", "record_index", "field", "rank", "review_batch", clean.severity_band(F.col("deviation")).alias("severity"))
)
query("basic_stats", f"""with {ATT} select batch_id, field, round(avg(v), 1) mean, round(median(v), 1) median, round(min(v), 1) low, round(max(v), 1) high from
 (select batch_id, '加班时长' field, hrs v from att union all select batch_id, '迟到次数', late from att) where v is not null group by 1, 2""")(
    lambda s, d: clean.basic_stats(attendance(s, d), NUM)
)
query("judge_batches", f"with {_IQR} select batch_id, record_index, field, rank::bigint seq, value > 10 as is_anomaly, false pending_review, case when value > 10 then 'large' else 'small' end reason from rk where (rank - 1) // 30 % 4 <> 3 union all select batch_id, record_index, field, rank, false, true, '待复核: ValueError' from rk where (rank - 1) // 30 % 4 = 3")(
    lambda s, d: clean.judge_batches(_ranked(s, d), _judge).drop("value")
)


def _judge(rows):
    """A stand-in for a model: fails on every fourth review batch."""
    if rows["review_batch"].iloc[0] % 4 == 3:
        raise ValueError("no answer")
    return rows.assign(is_anomaly=rows["value"] > 10, reason=["large" if v > 10 else "small" for v in rows["value"]])


query("mark_anomalies", f"with {_MARK} select batch_id, record_index, is_anomaly, anomaly_status, anomaly_reason from mk")(
    lambda s, d: clean.mark_anomalies(_filled(s, d), _verdicts(s, d)).select("batch_id", "record_index", "is_anomaly", "anomaly_status", "anomaly_reason")
)
query("pipeline_log", f"""with {_VERD}, w as (select a.batch_id, n, m, missing_before, coalesce(confirmed, 0) confirmed, coalesce(degraded, 0) degraded, coalesce(candidates, 0) candidates, coalesce(batches, 0) batches from (select batch_id, count(*) n from att group by 1) a
 join (select batch_id, count(*) m, sum((emp is null)::int + (dt is null)::int + (hrs is null)::int + (late is null)::int)::bigint missing_before from dd group by 1) b using (batch_id)
 left join (select batch_id, count(*) filter (is_anomaly and not pending_review) confirmed, count(distinct (seq - 1) // 30) filter (pending_review) degraded, count(*) candidates, count(distinct (seq - 1) // 30) batches from vd group by 1) c using (batch_id))
 select batch_id, 'dedup' step_name, n input_count, m output_count, n - m affected_count, concat('n=', n) details from w union all select batch_id, 'fill_missing', m, m, missing_before, concat('missing_after=0,missing_before=', missing_before) from w
 union all select batch_id, 'anomaly_detect', m, m, confirmed, concat('batches=', batches, ',candidates=', candidates, ',confirmed=', confirmed, ',degraded=', degraded) from w""")(
    lambda s, d: clean.pipeline_log(attendance(s, d), _deduped(s, d), clean.missing_stats(_deduped(s, d), _filled(s, d), NUM + CAT).select("batch_id", "missing_before", "missing_after"), _ranked(s, d), _verdicts(s, d)).withColumn("details", F.expr("array_join(array_sort(transform(map_entries(details), e -> concat(e.key, '=', e.value))), ',')"))
)
query("batch_date_range", f"with {ATT} select batch_id, concat(min(replace(dt, '/', '-')), ' ~ ', max(replace(dt, '/', '-'))) date_range from att group by 1")(lambda s, d: clean.batch_date_range(attendance(s, d)))
query("clean_summary", f"""with {_MARK} select a.batch_id, input_count, output_count, anomaly_count, pending_count from (select batch_id, count(*) input_count from att group by 1) a
 join (select batch_id, count(*) output_count, count(*) filter (is_anomaly) anomaly_count, count(*) filter (anomaly_status = 'pending_review') pending_count from mk group by 1) b using (batch_id)""")(
    lambda s, d: clean.clean_summary(attendance(s, d), clean.mark_anomalies(_filled(s, d), _verdicts(s, d)))
)
query("mark_raw_cleaned", "select event_id id, concat('att_', event_type) batch_id, case when event_type in ('click', 'view') then 'cleaned' else 'raw' end status from events")(
    lambda s, d: clean.mark_raw_cleaned(table(s, d, "events").selectExpr("event_id id", "concat('att_', event_type) batch_id", "'raw' status"), records(s, d).where("batch_id in ('att_click', 'att_view')")).select("id", "batch_id", "status")
)
query("override_anomalies", f"""with {REC} select id, case when id % 10 = 0 then id % 20 = 0 else is_anomaly end is_anomaly, case when id % 20 = 0 then 'by hand' else anomaly_reason end anomaly_reason,
 case when id % 10 = 0 then case when id % 20 = 0 then 'confirmed' else 'normal' end else anomaly_status end anomaly_status, anomaly_status = 'pending_review' and id % 10 <> 0 pending from facts""")(
    lambda s, d: clean.override_anomalies(records(s, d), records(s, d).where("id % 10 = 0").selectExpr("id", "id % 20 = 0 is_anomaly", "if(id % 20 = 0, 'by hand', null) reason")).selectExpr("id", "is_anomaly", "anomaly_reason", "anomaly_status", "pending_check_fields is not null pending")
)
query("rejudge_pending", f"""with {REC} select id, case when p and m = 0 then true when p and m = 1 then false else is_anomaly end is_anomaly, case when p and m = 0 then 'again 0' when p and m = 1 then '复核后判定为正常' else anomaly_reason end anomaly_reason,
 case when p and m = 0 then 'confirmed' when p and m = 1 then 'normal' else anomaly_status end anomaly_status, case when not p then 'kept' when m = 0 then 'confirmed' when m = 1 then 'cleared' else 'pending' end outcome
 from (select *, anomaly_status = 'pending_review' p, id % 4 m from facts)""")(
    lambda s, d: clean.rejudge_pending(records(s, d), records(s, d).where("anomaly_status = 'pending_review' and id % 4 < 3").selectExpr("id", "explode(array(0L, 1L)) seq").selectExpr("id", "seq", "id % 4 = 0 is_anomaly", "concat('again ', seq) reason", "id % 4 = 2 failed")).select("id", "is_anomaly", "anomaly_reason", "anomaly_status", "outcome")
)
query("list_anomalies", f"with {REC} select id, data_type, anomaly_status, count(*) over () total from facts where anomaly_status = 'confirmed' and data_type = 'sales' order by created_at desc, id limit 20 offset 20")(
    lambda s, d: (lambda page, total: page.select("id", "data_type", "anomaly_status").crossJoin(total))(*clean.list_anomalies(records(s, d), data_type="sales", page=2))
)
query("batch_logs", "select batch_id, created_at from (select concat('att_', event_type) batch_id, ts created_at from events) where batch_id = 'att_error'")(
    lambda s, d: clean.batch_logs(table(s, d, "events").selectExpr("concat('att_', event_type) batch_id", "ts created_at"), "att_error")
)

# lookup
query("query_records", f"""with {REC}, f as (select * from facts where data_type = 'sales' and (department = '2-HIGH' or k_dept = '2-HIGH') and ((record_date between date '1995-01-01' and date '1996-06-30') or (k_date between '1995-01-01' and '1996-06-30')))
 select id, data_type, ldept department, lname employee_name, coalesce(strftime(record_date, '%Y-%m-%d'), k_soon, k_date, '') record_date, (select count(*) from f) total from (select *, case when (id - 1) // 4 % 5 = 0 then 'soon' end k_soon from f) order by id limit 20""")(
    lambda s, d: lookup.query_records(records(s, d), data_type="sales", department="2-HIGH", start="1995-01-01", end="1996-06-30").drop("preview")
)
query("anomaly_details", f"""with {REC} select id, data_type, ldept department, lname employee_name, case when length(r) > 120 then concat(left(r, 120), '...') else r end reason from (select *, coalesce(nullif(anomaly_reason, ''), '未说明') r from facts) where is_anomaly and (department = 'BUILDING' or k_dept = 'BUILDING') order by id limit 10""")(
    lambda s, d: lookup.anomaly_details(records(s, d), department="BUILDING")
)
query("name_filter", f"with {REC} select id, lname from facts where employee_name in ('Customer#000000007') or k_name = 'Customer#000000007'")(
    lambda s, d: records(s, d).where(lookup.name_is("Customer#000000007")).select("id", lookup.record_name().alias("lname"))
)
query("date_filter", f"with {REC} select data_type, count(*) n from facts where record_date >= date '1996-01-01' and record_date <= date '2024-01-05' or k_date >= '1996-01-01' and k_date <= '2024-01-05' group by 1")(
    lambda s, d: records(s, d).where(lookup.date_between("1996-01-01", "2024-01-05")).groupBy("data_type").agg(F.count("*").alias("n"))
)
query("payload_preview", "select c_custkey * 4 + 2 id, concat('EmployeeID=', c_custkey, '，Name=', c_name, '，Dept=', c_mktsegment) preview from customer")(
    lambda s, d: records(s, d).where("data_type = 'customer'").select("id", lookup.payload_preview(3).alias("preview"))
)
query("summary_stats", f"""with {REC} select 'all' as scope, '' as name, count(*) total, count(*) filter (is_anomaly) anomalies, round(count(*) filter (is_anomaly) * 100.0 / count(*), 2) anomaly_rate, round(avg(q), 4) avg_quality from facts
 union all select 'type', type, count(*), count(*) filter (is_anomaly), round(count(*) filter (is_anomaly) * 100.0 / count(*), 2), round(avg(q), 4) from facts group by type
 union all select 'department', ldept, count(*), count(*) filter (is_anomaly), round(count(*) filter (is_anomaly) * 100.0 / count(*), 2), round(avg(q), 4) from facts group by ldept""")(
    lambda s, d: lookup.summary_stats(records(s, d))
)
query("payload_filters", f"""with {REC} select id, datediff('day', k_date::date, date '2024-06-30') as "days" from facts where type = 'sales' and k_value > 100000 and (id - 1) // 4 % 2 = 0""")(
    lambda s, d: records(s, d).where(lookup.payload_gt("订单金额", 100000)).where("(id - 1) / 4 % 2 = 0").select("id", lookup.stale_days("2024-06-30", "日期").alias("days"))
)
query("rank_groups", f"with {REC} select *, rank() over (order by total desc) rank from (select k_dept as \"group\", round(sum(k_value), 4) total, count(*) n from facts where type = 'customer' group by 1)")(
    lambda s, d: lookup.rank_groups(records(s, d).where("data_type = 'customer'"), lookup.payload("Dept"), lookup.payload_number("ContractAmount"))
)

# reports
_RATE = "count(*) filter (is_anomaly) anomalies, round(count(*) filter (is_anomaly) * 100.0 / count(*), 2) anomaly_rate"
query("anomaly_rate_report", f"with {REC} select rdept department, type data_type, count(*) total, {_RATE} from facts group by 1, 2")(lambda s, d: report.anomaly_rate_report(records(s, d)))
query("summary_by_type", f"with {REC} select type data_type, count(*) count, min(d) min_date, max(d) max_date, count(*) filter (is_anomaly) anomaly_count, round(count(*) filter (is_anomaly) * 100.0 / count(*), 2) anomaly_rate, round(avg(q), 4) avg_quality from facts group by 1")(lambda s, d: report.summary_by_type(records(s, d)))
query("summary_total", f"with {REC} select count(*) total, count(distinct batch_id) batches from facts")(lambda s, d: report.summary_total(records(s, d)))
query("trend_month", f"with {REC} select strftime(d, '%Y-%m') period, type data_type, count(*)::double as value from facts where d is not null group by 1, 2")(lambda s, d: report.trend(records(s, d)))
query("trend_day_rate", f"with {REC} select strftime(d, '%Y-%m-%d') period, type data_type, round(count(*) filter (is_anomaly) * 100.0 / count(*), 2) as value from facts where d is not null and type = 'attendance' group by 1, 2")(lambda s, d: report.trend(records(s, d), "anomaly_rate", "attendance", "day"))
query("quality_by_department", f"with {REC} select rdept department, count(*) total, {_RATE}, round(avg(q), 4) avg_quality, 0.0::double missing_rate from facts group by 1 union all select '全部', count(*), {_RATE}, round(avg(q), 4), 0.0 from facts")(lambda s, d: report.quality_report(records(s, d)))
_DASH = "count(*) count, count(*) filter (is_anomaly) anomaly_count, round(count(*) filter (is_anomaly) * 100.0 / count(*), 2) anomaly_rate, round(avg(q), 4) avg_quality from facts"
query("dashboard", f"""with {REC} select 'all' section, null data_type, null period, null department, {_DASH} union all select 'type', type, null, null, {_DASH} group by type
 union all select 'trend', type, strftime(d, '%Y-%m'), null, {_DASH} where d is not null group by type, strftime(d, '%Y-%m') union all select 'department', null, null, rdept, {_DASH} group by rdept""")(lambda s, d: report.dashboard(records(s, d)))
query("trend_pivot", f"with {REC} select strftime(d, '%Y-%m') period, nullif(count(*) filter (type = 'attendance'), 0)::double attendance, nullif(count(*) filter (type = 'sales'), 0)::double sales from facts where d is not null group by 1")(lambda s, d: report.trend_pivot(report.trend(records(s, d)), ["attendance", "sales"]))


def _raw(s, d):
    return records(s, d).selectExpr("id", "batch_id", "source_id", "id % 50 source_row_index", "if(is_anomaly, 'cleaned', 'raw') status", "created_at")


query("collect_history", f"""with {REC}, {SRC} select batch_id, source_id, n count, t0 collected_at, st status, name source_name, source_type from (select batch_id, source_id, count(*) n, min(created_at) t0, min(case when is_anomaly then 'cleaned' else 'raw' end) st from facts group by 1, 2) g
 left join src on src.id = source_id order by t0 desc, batch_id, source_id limit 5""")(lambda s, d: report.collect_history(_raw(s, d), sources(s), size=5))
query("collect_history_source", f"""with {REC}, {SRC} select batch_id, source_id, n count, t0 collected_at, st status, name source_name, source_type from (select batch_id, source_id, count(*) n, min(created_at) t0, min(case when is_anomaly then 'cleaned' else 'raw' end) st from facts where source_id = 1 group by 1, 2) g
 left join src on src.id = source_id""")(lambda s, d: report.collect_history(_raw(s, d), sources(s), source_id=1))
query("batch_detail", f"""with {REC}, {SRC} select r.id, source_row_index, total, name source_name, source_type from (select *, id % 50 source_row_index, count(*) over () total from facts where batch_id = 'sales_1' order by source_row_index, id limit 100) r left join src on src.id = r.source_id""")(
    lambda s, d: report.batch_detail(_raw(s, d), sources(s), "sales_1").select("id", "source_row_index", "total", "source_name", "source_type")
)


@query("source_overview", f"with {REC}, {SRC} select source_id, name, total, active, error, n from (select source_id, count(*) n from rec group by 1) join src on src.id = source_id cross join (select count(*) total, count(*) filter (status = 'active') active, count(*) filter (status = 'error') error from src) where source_type = 'csv'")
def _overview(s, d):
    counts, page = report.source_overview(sources(s), "csv")
    return records(s, d).groupBy("source_id").agg(F.count("*").alias("n")).join(F.broadcast(page.selectExpr("id source_id", "name")), "source_id").crossJoin(counts)


query("vocabulary", f"with {REC} select 'data_type' kind, data_type as value from facts where data_type is not null group by 2 union all select 'department', v from (select department v from facts union select k_dept from facts) where v is not null and v <> ''")(
    lambda s, d: _vocabulary(s, d)
)


def _vocabulary(s, d):
    from ..operators.routing import vocabulary

    return vocabulary(records(s, d))


query("department_lookup", f"with {REC} select ldept department, count(*) n from facts group by 1")(lambda s, d: records(s, d).groupBy(lookup_department().alias("department")).agg(F.count("*").alias("n")))
