"""Routing signals, execution checks, traces, chat history and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import LOOKUP_DEPARTMENT_KEYS, payload

# Labels, key words and marks that the checks look for.
LABELS = {"数": "data_query", "文": "doc_query", "混": "hybrid"}
DOC_KEYWORDS = ("规定", "制度", "政策", "标准", "流程", "怎么算", "怎么判定", "定义", "规则", "条件")
DATA_KEYWORDS = ("数据", "统计", "数量", "业绩", "指标", "排名", "多少条", "异常率", "质量分", "部门")
EMPTY_MARKERS = ("没有匹配的数据记录", "暂无数据可统计", "没有找到匹配的异常记录")
NONEMPTY_CUES = ("哪些", "哪个", "哪种", "多少", "几条", "几个", "几人", "谁", "排名", "最高", "最低", "最大", "最小", "top")
CAUSE_CUES = ("为什么", "原因", "依据", "根据什么", "怎么算", "凭什么", "规则", "口径", "判定标准")
POLICY_MARKERS = ("制度", "条款", "规定", "第", "依据", "因为", "根据", "办法", "流程")
CHECKED = ("data_type", "department")
THRESHOLD = 0.99


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(c.rlike("|".join(words)), F.lit(False))


def parse_model_json(c: Column, schema: str) -> Column:
    """JSON of a model's answer: fences are stripped; else the text from the first { to the last }; else null."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^\s*```\w*\s*$", ""))
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    text = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)
    return F.from_json(text, schema)


def normalise_logprobs(c: Column) -> Column:
    """Either shape (a list of token and logprob, or a map by token) as struct(chosen, top): token to log probability."""
    listed = F.from_json(c, "array<struct<token:string,logprob:double>>")
    keyed = F.from_json(c, "map<string,double>")
    pairs = F.filter(listed, lambda x: x["token"].isNotNull() & x["logprob"].isNotNull())
    best_of = lambda m: F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("t"))))["t"]
    top = F.when(F.trim(c).startswith("["), F.map_from_entries(F.filter(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["token"])), lambda t: F.struct(t, F.array_max(F.transform(F.filter(pairs, lambda x: x["token"] == t), lambda x: x["logprob"])))), lambda x: F.lit(True)))).otherwise(keyed)
    return F.when(F.size(top) > 0, F.struct(best_of(top).alias("chosen"), top.alias("top")))


def derive_signals(top: Column) -> Column:
    """Best legal label, its probability, the legal labels' sum, and the gap of the two best of all tokens; null without a legal label."""
    legal = F.map_filter(top, lambda k, v: k.isin(*LABELS))
    ranked = F.array_sort(F.transform(F.map_entries(legal), lambda e: F.struct((-F.exp(e["value"])).alias("p"), e["key"].alias("label"))))
    all_p = F.sort_array(F.transform(F.map_values(top), lambda v: F.exp(v)), asc=False)
    label = ranked[0]["label"]
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.when(F.size(legal) > 0, F.struct(
        names.getItem(label).alias("intent"), label.alias("label"), (-ranked[0]["p"]).alias("p_top"),
        F.aggregate(F.map_values(legal), F.lit(0.0), lambda a, v: a + F.exp(v)).alias("label_mass"),
        (F.get(all_p, F.lit(0)) - F.coalesce(F.get(all_p, F.lit(1)), F.lit(0.0))).alias("margin"),
    ))


def rule_classify(question: Column) -> Column:
    doc, data = _has(question, DOC_KEYWORDS), _has(question, DATA_KEYWORDS)
    row = lambda intent, p: F.struct(F.lit(intent).alias("intent"), F.lit(p).alias("confidence"))
    return F.when(doc & data, row("hybrid", 0.65)).when(doc, row("doc_query", 0.60)).when(data, row("data_query", 0.60)).otherwise(row("data_query", 0.30))


def route(df: DataFrame, question: str = "question", top: str = "top", threshold: float = THRESHOLD) -> DataFrame:
    """intent, confidence, path, degrade and mode: signals, else key words; what is not sure enough and not hybrid goes to hybrid."""
    signals, rule = F.col("_s"), F.col("_r")
    out = df.withColumn("_s", derive_signals(F.col(top))).withColumn("_r", rule_classify(F.col(question)))
    out = out.withColumns({
        "intent": F.coalesce(signals["intent"], rule["intent"]),
        "confidence": F.coalesce(signals["p_top"], rule["confidence"]),
        "path": F.when(signals.isNotNull(), "logprobs").otherwise("rule"),
        "degrade": F.when(signals.isNotNull(), "").when(F.col(top).isNull(), "no_distribution").otherwise("no_legal_label"),
        "p_top": F.coalesce(signals["p_top"], F.lit(0.0)), "label_mass": F.coalesce(signals["label_mass"], F.lit(0.0)), "margin": F.coalesce(signals["margin"], F.lit(0.0)),
    })
    return out.withColumn("mode", F.when((F.col("confidence") < threshold) & (F.col("intent") != "hybrid"), "hybrid").otherwise(F.col("intent"))).drop("_s", "_r")


def vocabulary(records: DataFrame) -> DataFrame:
    """(kind, value): data types and departments that occur, in the column or under any key."""
    values = F.array(F.struct(F.lit("data_type").alias("kind"), F.col("data_type").alias("value")), F.struct(F.lit("department").alias("kind"), F.col("department").alias("value")), *(F.struct(F.lit("department").alias("kind"), payload(k).alias("value")) for k in LOOKUP_DEPARTMENT_KEYS))
    return records.select(F.explode(values).alias("v")).select("v.*").where("value is not null and value <> ''").distinct()


def check_structure(traces: DataFrame, vocab: DataFrame, key: str = "trace_id") -> DataFrame:
    """(trace, structure, vocab): arguments outside the vocabulary. With an empty vocabulary nothing is checked."""
    known = not vocab.isEmpty()
    if not known:
        return traces.select(key, F.expr("cast(array() as array<string>)").alias("structure"), F.lit(False).alias("vocab"))
    used = traces.select(key, F.posexplode("tool_calls").alias("call", "c")).select(key, "call", F.posexplode(F.array(*(F.struct(F.lit(p).alias("kind"), F.col("c.args")[p].alias("value")) for p in CHECKED))).alias("n", "a")).select(key, "call", "n", "a.*").where("value <> ''")
    bad = used.join(vocab, ["kind", "value"], "left_anti").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("call", "n", F.concat_ws("=", "kind", "value").alias("m")))), lambda x: x["m"]).alias("structure"))
    return traces.select(key).join(bad, key, "left").select(key, F.coalesce("structure", F.expr("cast(array() as array<string>)")).alias("structure"), F.lit(True).alias("vocab"))


def check_empty(question: Column, answer: Column) -> Column:
    return _has(answer, EMPTY_MARKERS) & _has(F.lower(question), NONEMPTY_CUES)


def check_reference(question: Column, answer: Column) -> Column:
    return _has(question, CAUSE_CUES) & ~_has(answer, POLICY_MARKERS)


def inspect_execution(traces: DataFrame, vocab: DataFrame, key: str = "trace_id") -> DataFrame:
    """exec_check of each trace; a blocked agent's trace escalates to hybrid."""
    checked = traces.join(check_structure(traces, vocab, key), key)
    empty = (F.size("structure") == 0) & check_empty(F.col("question"), F.col("answer"))
    blocked = (F.size("structure") > 0) | empty
    check = F.struct("structure", empty.alias("empty"), check_reference(F.col("question"), F.col("answer")).alias("reference"), blocked.alias("blocked"), "vocab")
    return checked.withColumn("exec_check", check).withColumn("mode", F.when(F.col("exec_check.blocked") & (F.col("mode") == "agent"), "hybrid").otherwise(F.col("mode"))).drop("structure", "vocab")


def build_traces(df: DataFrame) -> DataFrame:
    """Trace rows with timings rounded to one place and signals to six."""
    return df.withColumns({"stage_timings": F.transform_values("stage_timings", lambda k, v: F.round(v, 1)), "latency_ms": F.round("latency_ms", 1), "p_top": F.round("p_top", 6), "label_mass": F.round("label_mass", 6), "route_margin": F.round("route_margin", 6)})


def build_chat(df: DataFrame) -> DataFrame:
    """Two chat rows for each query."""
    rows = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(role).alias("role"), F.col(c).alias("content")) for i, (role, c) in enumerate((("user", "question"), ("assistant", "answer")))))
    return df.select("session_id", "created_at", F.explode(rows).alias("m")).select("session_id", "created_at", "m.*")


def question_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def compress_history(chat: DataFrame, recent: int = 8, each: int = 500, most: int = 3000, fallback: int = 200) -> DataFrame:
    """For each session: the last ``recent`` messages, a transcript of older ones, and a stand-in summary of it.

    A line has five characters at least, so of the oldest messages only as many are gathered as ``most`` characters can hold; both
    ends of a session are cut by rank before anything is shuffled, however long it is.
    """
    at = lambda *order: F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    last = chat.withColumn("_n", at(F.desc("created_at"), F.desc("id"))).where(F.col("_n") <= recent)
    said = F.concat(F.when(F.col("role") == "user", "用户: ").otherwise("助手: "), F.substring(F.trim("content"), 1, each))
    first = chat.where(F.trim("content") != "").withColumn("_n", at("created_at", "id")).where(F.col("_n") <= most // 5 + 1 + recent).select("session_id", "created_at", "id", said.alias("_t"))
    same = F.expr("a.session_id <=> b.session_id and a.created_at <=> b.created_at and a.id <=> b.id")
    older = first.alias("a").join(last.select("session_id", "created_at", "id").alias("b"), same, "left_anti")
    before = F.coalesce(F.sum(F.length("_t") + 1).over(Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    older = older.withColumn("_before", before).where(F.col("_before") <= most)
    lines = older.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "_t"))).alias("_l")).select(F.col("session_id").alias("_s"), F.substring(F.array_join(F.transform("_l", lambda x: x["_t"]), "\n"), 1, most).alias("transcript"))
    out = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("recent"))
    out = out.join(lines, F.col("session_id").eqNullSafe(F.col("_s")), "left").select("session_id", "recent", F.coalesce("transcript", F.lit("")).alias("transcript"))
    return out.withColumn("summary", F.when(F.length("transcript") > fallback, F.concat(F.substring("transcript", 1, fallback), F.lit("……"))).otherwise(F.col("transcript")))


def _newest(feedback: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """(id, trace_id): the last trace of the same keys at or before each feedback, by day, so that one key is many groups."""
    rows = feedback.select("id", F.lit(None).cast("long").alias("trace_id"), "at", *keys).unionByName(traces.select(F.lit(None).cast("long").alias("id"), "trace_id", "at", *keys)).withColumn("day", F.to_date("at"))
    within = Window.partitionBy(*keys, "day").orderBy("at", F.col("id").isNotNull(), "trace_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last("trace_id", ignorenulls=True).over(within)).where("id is not null")
    days = rows.groupBy(*keys, "day").agg(F.max_by(F.when(F.col("id").isNull(), F.col("trace_id")), F.when(F.col("id").isNull(), F.struct("at", "trace_id"))).alias("newest"))
    before = days.withColumn("before", F.last("newest", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).drop("newest")
    return near.join(before, [*keys, "day"]).select("id", F.coalesce("near", "before").alias("trace_id"))


def link_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """The newest trace of the same question (and session, when given) at or before the feedback, else null.

    Rows of both are put in the order of time by question's hash and day; no pairs are made.
    """
    f = feedback.select("id", question_hash(F.col("question")).alias("_h"), F.col("session_id").alias("_s"), F.col("created_at").alias("at"))
    t = traces.select(F.col("id").alias("trace_id"), question_hash(F.col("question")).alias("_h"), F.col("session_id").alias("_s"), F.col("created_at").alias("at"))
    hit = _newest(f.where("_s is null and _h is not null"), t.where("_h is not null"), ["_h"]).unionByName(_newest(f.where("_s is not null and _h is not null"), t.where("_s is not null and _h is not null"), ["_h", "_s"]))
    return feedback.drop("trace_id").join(hit, "id", "left")


def list_feedback(feedback: DataFrame, rating: int | None = None, limit: int = 50) -> DataFrame:
    rows = feedback.where(F.col("rating") == rating) if rating is not None else feedback
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def trace_usage(traces: DataFrame) -> DataFrame:
    """By intent, mode and path: traces, mean iterations and latency, 90th percentile; evaluation sessions do not count."""
    rows = traces.where("not startswith(coalesce(session_id, ''), 'eval_')")
    return rows.groupBy("intent", "mode", "route_path").agg(F.count("*").alias("n"), F.round(F.avg("iterations"), 4).alias("iterations"), F.round(F.avg("latency_ms"), 4).alias("latency_ms"), F.round(F.percentile("latency_ms", F.lit(0.9)), 4).alias("p90"))


def tool_usage(traces: DataFrame) -> DataFrame:
    rows = traces.where("not startswith(coalesce(session_id, ''), 'eval_')")
    return rows.select(F.explode("tools_used").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))
