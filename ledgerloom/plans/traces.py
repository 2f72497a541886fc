"""Queries of routing, traces, feedback and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev, routing
from .adapters import REC, records, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# Events as routed questions: probabilities, words, tools and answers follow from the ids.
_P = "map('数', ln((1 + event_id % 60) / 100d), '文', ln((1 + event_id % 25) / 100d), if(event_id % 4 = 0, '混', '答'), ln(0.1d))"
_TOP = f"case when event_id % 10 = 0 then null when event_id % 10 = 1 then map('答', ln(0.6d)) else {_P} end top"
_QUESTION = "case event_id % 6 when 0 then '加班制度怎么规定' when 1 then '销售部异常率是多少' when 2 then '部门异常率的标准' when 3 then '郑十最近怎么样' when 4 then '有哪些产品' else '为什么是这个口径' end"
_ANSWER = "case event_id % 5 when 0 then '没有匹配的数据记录' when 1 then '根据第三条' when 2 then '暂无数据可统计' else '42' end"
_T = [
    "event_id id", "event_id trace_id", "concat(if(event_id % 8 = 0, 'eval_', 's'), user_id % 20) session_id", f"{_QUESTION} question", f"{_ANSWER} answer", "event_type intent", "if(event_id % 3 = 0, 'agent', 'data') mode",
    "cast(event_id % 7 as int) iterations", "if(event_id % 2 = 0, array('query_cleaned_records', 'get_summary_stats'), array('search_documents')) tools_used",
    "array(named_struct('name', 'query_cleaned_records', 'args', map('data_type', if(event_id % 9 = 0, 'products', 'sales'), 'department', if(event_id % 11 = 0, '市场部', '2-HIGH')))) tool_calls",
    "map('route', value, 'answer', value * 2) stage_timings", "if(event_id % 4 = 0, 'rule', 'logprobs') route_path", "value p_top", "value label_mass", "value route_margin", "value / 7 latency_ms", "ts created_at",
]


def _traces(s, d):
    return table(s, d, "events").selectExpr(*_T)


_SQLQ, _SQLA = _QUESTION, _ANSWER
_SIG = """sg as (select event_id, event_id % 10 = 0 as none, event_id % 10 = 1 as illegal, (1 + event_id % 60) / 100.0::double a, (1 + event_id % 25) / 100.0::double b, event_id % 4 = 0 h from events),
 pr as (select *, case when h then case when a >= b and a >= 0.1 then '数' when b > a and b >= 0.1 then '文' else '混' end else case when a >= b then '数' else '文' end end l0,
 case when h then greatest(a, b, 0.1) else greatest(a, b) end p, a + b + case when h then 0.1 else 0 end mass, list_reverse_sort([a, b, 0.1::double]) r from sg)"""


@query("route_signals", f"with {_SIG} select event_id, round(p, 6) p_top, round(mass, 6) label_mass, round(r[1] - r[2], 6) margin from pr where not none and not illegal")
def _signals(s, d):
    t = table(s, d, "events").selectExpr("event_id", _TOP).select("event_id", routing.derive_signals(F.col("top")).alias("s")).where("s is not null")
    return t.selectExpr("event_id", "round(s.p_top, 6) p_top", "round(s.label_mass, 6) label_mass", "round(s.margin, 6) margin")


query("normalise_logprobs", "select event_id, case when event_id % 3 = 2 then null when event_id % 60 >= event_id % 25 then 'a' else 'b' end chosen, case when event_id % 3 = 2 then null else 2 end n from events")(
    lambda s, d: table(s, d, "events").select("event_id", routing.normalise_logprobs(F.expr("""case event_id % 3 when 0 then concat('[{"token": "a", "logprob": ', event_id % 60, '.5}, {"token": "b", "logprob": ', event_id % 25, '.25}]') when 1 then concat('{"a": ', event_id % 60, '.5, "b": ', event_id % 25, '.25}') else 'oops' end""")).alias("x")).selectExpr("event_id", "x.chosen chosen", "size(x.top) n").withColumn("n", F.when(F.col("chosen").isNotNull(), F.col("n")))
)
_RULE = "case event_id % 6 when 0 then 'doc_query' when 1 then 'data_query' when 2 then 'hybrid' when 3 then 'data_query' when 4 then 'data_query' else 'data_query' end"
_CONF = "case event_id % 6 when 0 then 0.6 when 1 then 0.6 when 2 then 0.65 else 0.3 end::double"
query("rule_classify", f"select event_id, {_RULE} intent, {_CONF} confidence from events")(lambda s, d: table(s, d, "events").selectExpr("event_id", f"{_QUESTION} q").select("event_id", routing.rule_classify(F.col("q")).alias("r")).select("event_id", "r.*"))
query("route", f"""with {_SIG}, x as (select event_id, none or illegal k, case when none then 'no_distribution' when illegal then 'no_legal_label' else '' end degrade, case when none or illegal then {_RULE} else case l0 when '数' then 'data_query' when '文' then 'doc_query' else 'hybrid' end end intent, case when none or illegal then {_CONF} else p end c from pr)
 select intent, degrade, case when c < 0.99 and intent <> 'hybrid' then 'hybrid' else intent end mode, count(*) n, round(avg(c), 4) confidence from x group by 1, 2, 3""")(
    lambda s, d: routing.route(table(s, d, "events").selectExpr("event_id", f"{_QUESTION} question", _TOP)).groupBy("intent", "degrade", "mode").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
)
query("check_structure", "select event_id trace_id, concat_ws(',', case when event_id % 9 = 0 then 'data_type=products' end, case when event_id % 11 = 0 then 'department=市场部' end) bad from events")(
    lambda s, d: routing.check_structure(_traces(s, d), routing.vocabulary(records(s, d))).select("trace_id", F.array_join("structure", ",").alias("bad"))
)
_E = f"event_id % 9 <> 0 and event_id % 11 <> 0 and event_id % 5 in (0, 2) and event_id % 6 in (1, 4)"
query("exec_check", f"""select event_id trace_id, {_E} "empty", event_id % 6 = 5 and event_id % 5 <> 1 reference, event_id % 9 = 0 or event_id % 11 = 0 or ({_E}) blocked, true vocab, case when event_id % 3 = 0 and (event_id % 9 = 0 or event_id % 11 = 0 or ({_E})) then 'hybrid' when event_id % 3 = 0 then 'agent' else 'data' end mode from events""")(
    lambda s, d: routing.inspect_execution(_traces(s, d), routing.vocabulary(records(s, d))).selectExpr("trace_id", "exec_check.empty `empty`", "exec_check.reference reference", "exec_check.blocked blocked", "exec_check.vocab vocab", "mode").withColumn("reference", F.col("reference"))
)
query("build_traces", "select event_id trace_id, round(value / 7.001::double, 1) latency_ms, round(value * 2, 1) answer from events")(lambda s, d: routing.build_traces(_traces(s, d).withColumn("latency_ms", F.col("p_top") / 7.001)).selectExpr("trace_id", "latency_ms", "stage_timings['answer'] answer"))
query("build_chat", f"select event_id, 0 part, 'user' \"role\", {_SQLQ} content from events union all select event_id, 1, 'assistant', {_SQLA} from events")(
    lambda s, d: routing.build_chat(_traces(s, d).withColumn("session_id", F.col("trace_id"))).select(F.col("session_id").alias("event_id"), "part", "role", "content")
)
query("question_hash", "select user_id, substr(sha256(concat('问', user_id)), 1, 16) h from events group by 1")(lambda s, d: table(s, d, "events").select("user_id").distinct().select("user_id", routing.question_hash(F.expr("concat('问', user_id)")).alias("h")))
_CHAT = """lt as (select conv_id, turn, case when role = 'user' then '用户: ' else '助手: ' end || substr(trim(text), 1, 100) t, row_number() over (partition by conv_id order by turn desc) n, text from conversations)"""
query("history_window", f"""with {_CHAT}, g as (select conv_id session_id, count(*) filter (n <= 3) recent, substr(coalesce(string_agg(t, chr(10) order by turn) filter (n > 3 and trim(text) <> ''), ''), 1, 300) transcript from lt group by 1)
 select session_id, recent, md5(transcript) transcript, md5(case when length(transcript) > 50 then substr(transcript, 1, 50) || '……' else transcript end) summary from g""")(
    lambda s, d: routing.compress_history(table(s, d, "conversations").selectExpr("conv_id session_id", "turn id", "role", "text content", "timestampadd(minute, cast(turn as int), timestamp '2024-01-01') created_at"), 3, 100, 300, 50).select("session_id", F.size("recent").cast("long").alias("recent"), F.md5("transcript").alias("transcript"), F.md5("summary").alias("summary"))
)
_FB = ["event_id id", "if(event_id % 2 = 0, null, concat('s', user_id % 20)) session_id", "concat('q', user_id) question", "if(event_id % 3 = 0, 1, -1) rating", "ts created_at", "concat('c', event_id) comment", "cast(null as long) trace_id"]
# every event is a trace, up to eleven hours later, and feedback on an earlier one
query("link_feedback", """with f as (select event_id id, event_id % 2 = 0 any_session, user_id % 50 u, event_id % 5 s, ts from events), t as (select event_id id, user_id % 50 u, event_id % 5 s, ts + to_hours((event_id % 12)::int) ts from events),
 a as (select u, ts, max(id) id from t group by 1, 2), b as (select u, s, ts, max(id) id from t group by 1, 2, 3)
 select f.id, a.id trace_id from f asof left join a on f.u = a.u and f.ts >= a.ts where any_session union all select f.id, b.id from f asof left join b on f.u = b.u and f.s = b.s and f.ts >= b.ts where not any_session""")(
    lambda s, d: routing.link_feedback(table(s, d, "events").selectExpr("event_id id", "if(event_id % 2 = 0, null, concat('s', event_id % 5)) session_id", "concat('q', user_id % 50) question", "ts created_at"), table(s, d, "events").selectExpr("event_id id", "concat('s', event_id % 5) session_id", "concat('q', user_id % 50) question", "timestampadd(HOUR, cast(event_id % 12 as int), ts) created_at")).select("id", "trace_id")
)
query("list_feedback", "select event_id id from events where event_id % 3 <> 0 order by ts desc, event_id desc limit 50")(lambda s, d: routing.list_feedback(table(s, d, "events").selectExpr(*_FB), -1).select("id"))
query("trace_usage", "select event_type intent, case when event_id % 3 = 0 then 'agent' else 'data' end mode, case when event_id % 4 = 0 then 'rule' else 'logprobs' end route_path, count(*) n, round(avg(event_id % 7), 4) iterations, round(avg(value / 7), 4) latency_ms, round(quantile_cont(value / 7, 0.9), 4) p90 from events where event_id % 8 <> 0 group by 1, 2, 3")(lambda s, d: routing.trace_usage(_traces(s, d)))
query("tool_usage", "select tool, count(*) n from (select unnest(case when event_id % 2 = 0 then ['query_cleaned_records', 'get_summary_stats'] else ['search_documents'] end) tool from events where event_id % 8 <> 0) group by 1")(lambda s, d: routing.tool_usage(_traces(s, d)))
query("parse_model_json", "select event_id, case when event_id % 4 = 3 then null else event_id % 100 end v from events")(
    lambda s, d: table(s, d, "events").select("event_id", routing.parse_model_json(F.expr("""case event_id % 4 when 0 then concat('```json\n{"v": ', event_id % 100, '}\n```') when 1 then concat('The answer: {"v": ', event_id % 100, '} .') when 2 then concat('{"v": ', event_id % 100, '}') else 'no {json here' end"""), "v long")["v"].alias("v"))
)

# Evaluation rows from events: expectation by id, prediction by another rule, confidence from props.
_EXP = "case event_id % 4 when 0 then 'data_query' when 1 then 'doc_query' when 2 then 'hybrid' else {blank} end"
_PRED = "case when user_id % 5 = 0 then 'hybrid' when user_id % 5 = 1 then 'doc_query' else case event_id % 4 when 1 then 'doc_query' else 'data_query' end end"
_KEY = "cast(get_json_object(props, '$.k') as int) / 100d"
_KSQL = "cast(json_extract(props, '$.k') as int) / 100.0::double"
_EV = f"ev as (select event_id id, {_EXP.format(blank=chr(39) * 2)} expected, {_PRED} predicted, {_KSQL} confidence, value, user_id, ts from events), er as (select *, expected = predicted correct from ev where expected <> '')"


def _rows(s, d):
    return table(s, d, "events").selectExpr("event_id id", f"{_EXP.format(blank=chr(39) * 2)} expected", f"{_PRED} predicted", f"{_KEY} confidence", "value", "user_id", "ts").withColumn("correct", F.expr("expected = predicted"))


def _real(s, d):
    return _rows(s, d).where("expected <> ''")


query("intent_accuracy", f"with {_EV} select count(*) n, count(*) filter (correct) correct, round(count(*) filter (correct) / count(*), 6) accuracy from er")(lambda s, d: ev.intent_accuracy(_rows(s, d)))
query("intent_errors", f"with {_EV} select id from er where not correct")(lambda s, d: ev.intent_errors(_rows(s, d)).select("id"))
_TOOL = ["event_id id", "case event_id % 3 when 0 then array('a', 'b', 'a') when 1 then array('c') else cast(array() as array<string>) end expected_tools", "case event_id % 5 when 0 then null when 1 then array('a') when 2 then array('b', 'c', 'c') else array('a', 'b', 'd') end used_tools"]
_TSQL = """ts as (select event_id id, case event_id % 3 when 0 then ['a', 'b'] else ['c'] end e, case event_id % 5 when 0 then []::varchar[] when 1 then ['a'] when 2 then ['b', 'c'] else ['a', 'b', 'd'] end u from events where event_id % 3 <> 2),
 tt as (select id, case when len(u) = 0 then 0.0 else round(len(list_intersect(e, u)) / len(u), 2) end::double as "precision", round(len(list_intersect(e, u)) / len(e), 2)::double recall from ts)"""
query("tool_scores", f"with {_TSQL} select * from tt")(lambda s, d: ev.tool_scores(table(s, d, "events").selectExpr(*_TOOL)))
query("tool_means", f"with {_TSQL} select count(*) n, round(avg(tt.precision), 4) as \"precision\", round(avg(recall), 4) recall from tt")(lambda s, d: ev.tool_means(ev.tool_scores(table(s, d, "events").selectExpr(*_TOOL))))
query("arg_check", "select event_id id, event_id % 4 <> 0 and event_id % 3 <> 1 matched from events where event_id % 5 <> 0")(
    lambda s, d: ev.arg_check(table(s, d, "events").selectExpr("event_id id", "if(event_id % 5 = 0, cast(map() as map<string, map<string, string>>), map('t', map('k', ' v '))) expected_args", "array(named_struct('name', 'o', 'args', map('k', 'v')), named_struct('name', if(event_id % 4 = 0, 'x', 't'), 'args', map('k', if(event_id % 3 = 1, 'w', 'v ')))) calls"))
)
_HIT = "array('the', 'que', 'und')"
query("keyword_hit_rate", "select doc_id % 50 id, round(avg((contains(text, 'the') or contains(text, 'que') or contains(text, 'und'))::int), 2) rate from documents group by 1")(
    lambda s, d: ev.keyword_hit_rate(table(s, d, "documents").selectExpr("doc_id % 50 id", "text content"), table(s, d, "documents").where("doc_id < 50").selectExpr("doc_id id", f"{_HIT} keywords"))
)
query("semantic_hit_rate", "select doc_id % 50 id, round(avg(quality), 2) rate from labels where doc_id % 50 % 3 <> 0 group by 1")(
    lambda s, d: ev.semantic_hit_rate(table(s, d, "labels").selectExpr("doc_id % 50 id", "quality = 1 relevant"), table(s, d, "documents").where("doc_id < 50").selectExpr("doc_id id", "case doc_id % 3 when 0 then 'data_query' when 1 then 'hybrid' else 'doc_query' end expected_intent"))
)
query("hit_rate_gaps", "with k as (select doc_id % 50 id, round(avg(toxic), 2) rate from labels group by 1), q as (select doc_id % 50 id, round(avg(quality), 2) rate from labels group by 1) select id, k.rate keyword, q.rate semantic, round(q.rate - k.rate, 2) gap, case when q.rate > k.rate then 'semantic_higher' else 'keyword_higher' end direction from k join q using (id) where abs(round(q.rate - k.rate, 2)) >= 0.4")(
    lambda s, d: ev.hit_rate_gaps(*(table(s, d, "labels").groupBy((F.col("doc_id") % 50).alias("id")).agg(F.round(F.avg(c), 2).alias("rate")) for c in ("toxic", "quality")))
)
query("answer_quality", """with r as (select event_id % 6 = 0 edge, event_id % 10 = 0 brief, (event_id % 5 + 1)::double a, (event_id % 4 + 1)::double b, (event_id % 3 + 1)::double c, case when event_id % 7 = 0 then 3.0::double end o from events),
 x as (select edge, case when brief then 1 else a end a, case when brief then 1 else b end b, case when brief then 1 else c end c, case when brief then 1 else coalesce(o, round((a + b + c) / 3, 1)) end o from r)
 select edge, count(*) n, round(avg(a), 4) relevance, round(avg(b), 4) completeness, round(avg(c), 4) accuracy, round(avg(o), 4) overall from x group by 1""")(
    lambda s, d: ev.answer_quality(table(s, d, "events").selectExpr("if(event_id % 6 = 0, 'edge', 'x') category", "if(event_id % 10 = 0, 'short', 'long enough answer') answer", "cast(event_id % 5 + 1 as double) relevance", "cast(event_id % 4 + 1 as double) completeness", "cast(event_id % 3 + 1 as double) accuracy", "if(event_id % 7 = 0, 3d, null) overall"))
)
query("pipeline_diagnostics", """select count(*) n, round(avg((event_id % 4 = 0)::int), 6) rule_share, round(avg((event_id % 3 = 0 and event_id % 5 <> 0 and not coalesce(event_id % 7 = 0 and event_id % 10 <> 9, false))::int), 6) escalated_before,
 round(avg((event_id % 7 = 0 and event_id % 10 <> 9)::int), 6) escalated_after, count(*) filter (event_id % 7 = 0 and event_id % 10 <> 9) structure, count(*) filter (event_id % 11 = 0 and event_id % 10 <> 9) "empty", count(*) filter (event_id % 13 = 0 and event_id % 10 <> 9) reference, count(*) filter (event_id % 10 = 9 or event_id % 17 = 0) blind from events""")(
    lambda s, d: ev.pipeline_diagnostics(table(s, d, "events").selectExpr("if(event_id % 4 = 0, 'rule', 'logprobs') path", "if(event_id % 3 = 0, 'hybrid', 'data_query') mode", "if(event_id % 5 = 0, 'hybrid', 'data_query') intent", "if(event_id % 10 = 9, null, named_struct('structure', if(event_id % 7 = 0, array('x'), cast(array() as array<string>)), 'empty', event_id % 11 = 0, 'reference', event_id % 13 = 0, 'blocked', event_id % 7 = 0, 'vocab', event_id % 17 <> 0)) exec_check"))
)
query("overall_score", f"with {_EV}, a as (select round(count(*) filter (correct) / count(*), 6) accuracy from er), {_TSQL}, p as (select round(avg(tt.precision), 4) as \"precision\" from tt), r as (select round(avg(quality), 4) rate from labels), q as (select round(avg(value), 4) overall from events) select accuracy, p.precision as \"precision\", rate, overall, round(0.25 * accuracy + 0.25 * p.precision + 0.15 * rate + 0.35 * overall / 5, 4) score from a, p, r, q")(
    lambda s, d: ev.overall_score(ev.intent_accuracy(_rows(s, d)), ev.tool_means(ev.tool_scores(table(s, d, "events").selectExpr(*_TOOL))), table(s, d, "labels").agg(F.round(F.avg("quality"), 4).alias("rate")), table(s, d, "events").agg(F.round(F.avg("value"), 4).alias("overall")))
)
_TH = [0.25, 0.5, 0.75, 0.9, 0.99]
_SCAN = f"""{_EV}, th as (select unnest({_TH})::double threshold), sc as (select threshold, round(count(*) filter (predicted <> 'hybrid' and confidence < threshold) / count(*), 6) escalation_rate, count(*) filter (not correct and not (predicted <> 'hybrid' and confidence < threshold)) silent,
 round(count(*) filter (not correct and predicted <> 'hybrid' and confidence < threshold) / count(*) filter (not correct), 6) caught_share, count(*) filter (expected = 'hybrid' and predicted <> 'hybrid' and not confidence < threshold) high,
 round(count(*) filter (predicted <> 'hybrid' and confidence < threshold) / count(*) + 4.0 * count(*) filter (expected = 'hybrid' and predicted <> 'hybrid' and not confidence < threshold) / count(*), 6) cost from er, th group by 1)"""
query("threshold_scan", f"with {_SCAN} select * from sc")(lambda s, d: ev.scan_thresholds(_real(s, d), _TH))
query("flat_region", f"with {_SCAN} select threshold, cost, (select min(cost) from sc) lowest from sc where cost <= (select min(cost) from sc) * 1.2")(lambda s, d: ev.flat_region(ev.scan_thresholds(_real(s, d), _TH), 0.2))
_CAL = f"""{_EV}, cb as (select case when confidence >= 0.9 then 0.9 when confidence >= 0.8 then 0.8 when confidence >= 0.7 then 0.7 when confidence >= 0.6 then 0.6 when confidence >= 0.5 then 0.5 else 0.0 end::double bin, count(*) n, round(avg(confidence), 6) confidence, round(avg(correct::int), 6) accuracy from er group by 1)"""
query("calibration", f"with {_CAL} select *, round(confidence - accuracy, 6) gap from cb")(lambda s, d: ev.calibration(_real(s, d)))
query("calibration_summary", f"with {_CAL} select (select round(sum(abs(round(confidence - accuracy, 6)) * n) / sum(n), 4) from cb) ece, (select count(*) from cb) bins, count(distinct confidence) \"values\", min(confidence) low, median(confidence) middle, max(confidence) high from er")(lambda s, d: ev.calibration_summary(_real(s, d)))
query("join_signals", """with l as (select substr(sha256(concat('q', user_id)), 1, 16) h, min_by(value, ts) v from events where ts >= timestamp '2024-01-03' group by 1) select event_id id, v p_top from events left join l on h = substr(sha256(concat('q', user_id % 60)), 1, 16)""")(
    lambda s, d: ev.join_signals(table(s, d, "events").selectExpr("event_id id", "concat('q', user_id % 60) question"), table(s, d, "events").selectExpr("substr(sha2(concat('q', user_id), 256), 1, 16) q_hash", "value p_top", "value label_mass", "value margin", "ts logged_at"), F.lit("2024-01-03").cast("timestamp")).select("id", "p_top")
)
query("signal_separation", f"with {_EV} select 'confidence' signal, list_sort(list(confidence) filter (not correct))[len(list(confidence) filter (not correct)) // 2 + 1] wrong, list_sort(list(confidence) filter (correct))[len(list(confidence) filter (correct)) // 2 + 1] \"right\", round(list_sort(list(confidence) filter (correct))[len(list(confidence) filter (correct)) // 2 + 1] - list_sort(list(confidence) filter (not correct))[len(list(confidence) filter (not correct)) // 2 + 1], 6) difference from er")(lambda s, d: ev.signal_separation(_real(s, d), ("confidence",)))
query("signal_sweep", f"with {_EV}, th as (select unnest({_TH})::double threshold) select threshold, round(count(*) filter (confidence < threshold) / count(*), 6) escalated, round(count(*) filter (confidence < threshold and not correct) / count(*) filter (not correct), 6) caught from er, th group by 1")(lambda s, d: ev.signal_sweep(_real(s, d), "confidence", _TH))
query("run_metrics", f"""with {_EV}, r as (select *, user_id % 3 run, row_number() over (partition by user_id % 3 order by value, id) - 1 i, count(*) over (partition by user_id % 3) c from er) select run, count(*) n, round(avg(correct::int), 6) accuracy, round(avg(correct::int) filter (expected = 'data_query'), 6) accuracy_data_query, round(avg(correct::int) filter (expected = 'doc_query'), 6) accuracy_doc_query, round(avg(correct::int) filter (expected = 'hybrid'), 6) accuracy_hybrid,
 count(*) filter (expected <> 'hybrid' and predicted = 'hybrid') over_escalated, count(*) filter (expected = 'hybrid' and predicted <> 'hybrid') missed_hybrid, count(*) filter (expected = 'doc_query' and predicted = 'data_query') doc_to_data, count(*) filter (id % 7 = 0) rule_path, median(value) median_ms, max(value) filter (i = floor(c * 0.9)) p90_ms, max(value) max_ms from r group by 1""")(
    lambda s, d: ev.run_metrics(_real(s, d).withColumns({"run": F.col("user_id") % 3, "latency_ms": F.col("value"), "path": F.expr("if(id % 7 = 0, 'rule', 'x')")}))
)
query("diff_runs", f"with {_EV} select id, expected, predicted before, 'hybrid' \"after\", case when expected = 'hybrid' then 'better' when expected = predicted then 'worse' else 'other' end mark from er where id % 3 = 0 and predicted <> 'hybrid'")(
    lambda s, d: ev.diff_runs(_real(s, d), _real(s, d).withColumn("predicted", F.expr("if(id % 3 = 0, 'hybrid', predicted)")))
)
query("parse_self_report", "select event_id, case event_id % 5 when 0 then 'hybrid' when 1 then 'hybrid' when 2 then 'doc_query' when 3 then 'data_query' else 'data_query' end intent, case event_id % 5 when 0 then 1.0 when 1 then 0.6 when 2 then 0.6 when 3 then 0.6 else 0.5 end::double confidence from events")(
    lambda s, d: table(s, d, "events").select("event_id", ev.parse_self_report(F.expr("""case event_id % 5 when 0 then '{"intent": "hybrid", "confidence": 1.7}' when 1 then 'I say doc or Hybrid' when 2 then 'a doc question' when 3 then 'data_query' else 'database' end""")).alias("r")).select("event_id", "r.*")
)

# Datasets: documents' first words as questions, in blocks by source, variants of every fourth.
_DS = ["doc_id id", "concat(left(split_part(text, '\n', 1), 12 + cast(doc_id % 3 as int)), case doc_id % 4 when 0 then '是多少？' when 1 then '' when 2 then '有多少的情况？' else '，查一下' end) question", "if(doc_id % 4 = 1, concat('variant_of_', doc_id - 1), concat('original_', doc_id)) source", "source block", "case doc_id % 5 when 0 then 'edge' when 1 then 'hybrid' when 2 then 'doc_query' else 'data_query' end category",
       "if(doc_id % 7 = 0, '', case doc_id % 5 when 1 then 'hybrid' when 2 then 'doc_query' else 'data_query' end) expected_intent", "if(doc_id % 11 = 0, array('other_tool'), array('search_documents')) expected_tools", "if(doc_id % 4 = 0, array('k'), cast(null as array<string>)) keywords", "if(doc_id % 6 = 0, array('k'), cast(null as array<string>)) expected_doc_keywords"]
_DSQL = """ds as (select doc_id id, concat(left(split_part(text, chr(10), 1), 12 + (doc_id % 3)::int), case doc_id % 4 when 0 then '是多少？' when 1 then '' when 2 then '有多少的情况？' else '，查一下' end) question, doc_id % 4 = 1 variant, source block,
 case doc_id % 5 when 0 then 'edge' when 1 then 'hybrid' when 2 then 'doc_query' else 'data_query' end category, case when doc_id % 7 = 0 then '' else case doc_id % 5 when 1 then 'hybrid' when 2 then 'doc_query' else 'data_query' end end expected_intent from documents)"""


def _ds(s, d):
    return table(s, d, "documents").selectExpr(*_DS)


_ASK = "regexp_replace(trim(question), '[？?]+$', '')"
query("dataset_qa", f"with {_DSQL} select 'id_gaps' \"check\", max(id) - min(id) + 1 - count(distinct id) n from ds union all select 'repeated', count(*) - count(distinct {_ASK}) from ds union all select 'too_short', count(*) filter (length(trim(question)) < 12) from ds union all select 'too_long', count(*) filter (length(trim(question)) > 14) from ds")(lambda s, d: ev.dataset_qa(_ds(s, d), 12, 14))
query("dataset_fix", f"with {_DSQL}, f as (select {_ASK} a, min(id) old from ds group by 1) select old, row_number() over (order by old) id from f")(lambda s, d: ev.dataset_fix(_ds(s, d).withColumn("old", F.col("id"))).select("old", "id"))
query("variant_drift", "with v as (select doc_id id, doc_id - 1 origin, concat('n', doc_id % 8) question, concat('n', (doc_id - 1) % 6, ' A') original from documents where doc_id % 4 = 1) select id, origin, case when not contains(question, ((id - 1) % 6)::varchar) then 'number_lost' else 'entity_lost' end reason from v where true")(
    lambda s, d: ev.variant_drift(table(s, d, "documents").selectExpr("doc_id id", "if(doc_id % 4 = 1, concat('variant_of_', doc_id - 1), 'original_1') source", "concat(if(doc_id % 4 = 1, concat('n', doc_id % 8), concat('n', doc_id % 6, ' §A')), ' ', regexp_replace(text, '[0-9]', '')) question"), s.createDataFrame([("§A",)], "name string"))
)
query("dataset_balance", f"with {_DSQL} select category, count(*) items, count(distinct case when variant then id - 1 else id end) \"groups\", round(count(*) / count(distinct case when variant then id - 1 else id end), 4) expansion from ds where category <> 'edge' group by 1")(lambda s, d: ev.dataset_balance(_ds(s, d)))
query("error_balance", f"with {_DSQL}, g as (select case when variant then ds.id - 1 else ds.id end g, count(*) n, count(*) filter (quality = 0) e from ds join labels on doc_id = ds.id where category <> 'edge' group by 1) select round(sum(e) / sum(n), 6) by_item, round(count(*) filter (e > 0) / count(*), 6) by_group from g")(lambda s, d: ev.error_balance(_ds(s, d), table(s, d, "labels").selectExpr("doc_id id", "quality = 1 correct")))
query("assemble_sets", "select source block, count(*) items, 60 quota, greatest(0, 60 - count(*)) missing from documents group by 1 union all select 'none', 0, 60, 60")(
    lambda s, d: ev.assemble_sets(table(s, d, "documents").selectExpr("source block"), table(s, d, "documents").selectExpr("source block").distinct().union(s.sql("select 'none'")).withColumn("quota", F.lit(60)))
)
_NQ = r"regexp_replace(question, '是多少|有多少|多少|怎么样|是什么|有哪些|哪些|分别|一共|总共|的|了|吗|呢|啊|呀|请问|帮我|查一下|看一下|统计|情况|[\s，。？！,?!、]+', '', 'g')"
query("near_duplicates", f"with {_DSQL}, g as (select {_NQ} t, count(*) n, count(distinct block) b, count(distinct question) q from ds group by 1) select md5(t) h, n, b \"blocks\", case when q = 1 then 'exact' when b = 1 then 'in_block' else 'cross_block' end kind from g where n > 1 and length(t) >= 3")(lambda s, d: ev.near_duplicates(_ds(s, d)).select(F.md5("text").alias("h"), "n", "blocks", "kind"))
query("set_overlap", f"with {_DSQL} select md5(t) h from (select {_NQ} t from ds where id % 2 = 0 intersect select {_NQ} from ds where id % 2 = 1)")(lambda s, d: ev.set_overlap(_ds(s, d).where("id % 2 = 0"), _ds(s, d).where("id % 2 = 1")).select(F.md5("text").alias("h")))
query("field_checks", f"with {_DSQL} select id, 'edge_with_intent' problem from ds where category = 'edge' and expected_intent <> '' union all select id, 'intent_differs' from ds where category <> 'edge' and expected_intent <> category union all select id, 'unknown_tool' from ds where id % 11 = 0 union all select id, 'keywords_missing' from ds where category in ('doc_query', 'hybrid') and id % 6 <> 0")(lambda s, d: ev.field_checks(_ds(s, d)))
_EQ = "case doc_id % 4 when 0 then '张三在财务部的加班' when 1 then '张三在销售部的加班' when 2 then '火星部的业绩' else '销售部和财务部' end"
query("entity_checks", "select doc_id id, case doc_id % 4 when 0 then 'foreign_department' else 'invented_department' end problem from documents where doc_id % 4 = 0 or (doc_id % 4 = 2 and doc_id % 3 = 0)")(
    lambda s, d: ev.entity_checks(table(s, d, "documents").selectExpr("doc_id id", f"concat({_EQ}, ' ', text) question", "if(doc_id % 3 = 0, 'data_query', 'hybrid') category"), s.createDataFrame([("张三", "销售部"), ("李四", "财务部")], "employee string, department string"))
)
query("backfill_keywords", "select doc_id id, case when doc_id % 4 = 0 then 'k' when doc_id % 4 = 1 then 'k' when doc_id % 4 = 2 and doc_id % 3 = 0 then 's' end keyword, (doc_id % 4 = 3 or (doc_id % 4 = 2 and doc_id % 3 <> 0)) and doc_id % 5 in (1, 2) gap from documents")(
    lambda s, d: ev.backfill_keywords(_ds(s, d), table(s, d, "documents").where("doc_id % 3 = 0 and doc_id % 4 <> 3").selectExpr("doc_id id", "array('s') keywords")).selectExpr("id", "keywords[0] keyword", "gap")
)
query("parse_variants", "with o as (select doc_id, trim(translate(text, chr(10) || '\"', '  ')) t, unnest([1, 2]) nth from documents) select (select max(doc_id) from documents) + row_number() over (order by doc_id, nth) id, concat('variant_of_', doc_id) source, md5(trim(concat('variant ', nth, ' of ', doc_id, ' ', case when nth = 1 then t else '' end))) question from o")(
    lambda s, d: ev.parse_variants(table(s, d, "documents").selectExpr("doc_id id", "concat('1. \"variant 1 of ', doc_id, ' ', trim(translate(text, '\n\"', '  ')), '\"\n\n2) x\n- variant 2 of ', doc_id, '\n3、variant 3 of ', doc_id) text"), _ds(s, d), 2).select("id", "source", F.md5("question").alias("question"))
)
query("export_candidates", "with b as (select concat('q', user_id) question, max(ts) created_at, max_by(concat('c', event_id), ts) \"comment\", max(event_id) feedback_id from events where event_id % 3 <> 0 group by 1) select *, case when feedback_id % 2 = 0 then 'hybrid' else '' end expected_intent, case when feedback_id % 2 = 0 then 'ready' else 'pending' end status from b where question not in (select concat('q', user_id) from events where user_id % 7 = 0)")(
    lambda s, d: _candidates(s, d)
)


def _candidates(s, d):
    e = table(s, d, "events")
    known = e.where("event_id % 3 <> 0").groupBy(F.expr("concat('q', user_id)").alias("question")).agg(F.max("event_id").alias("m")).where("m % 2 = 0").selectExpr("question", "'hybrid' expected_intent", "'ready' status")
    return ev.export_candidates(e.selectExpr(*_FB), e.where("user_id % 7 = 0").selectExpr("concat('q', user_id) question"), known)


query("merge_candidates", "with c as (select concat('q', user_id) question, max(event_id) f from events where event_id % 3 <> 0 and user_id % 7 <> 0 group by 1), m as (select * from c where f % 2 = 0) select doc_id id, null question, concat('original_', doc_id) source from documents where doc_id < 0 union all select (select max(doc_id) from documents) + row_number() over (order by f), question, concat('feedback_', f) from m")(
    lambda s, d: ev.merge_candidates(_candidates(s, d), _ds(s, d))[0].where("source like 'feedback%'").select("id", "question", "source")
)
