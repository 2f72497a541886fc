"""Evaluation of answers and routes, and upkeep of evaluation datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order import rank_in_groups
from ..functions.patterns import find_names
from .routing import parse_model_json, question_hash

# Weights, prices of a threshold scan, calibration bins, tools, stop phrases.
WEIGHTS = {"intent": 0.25, "tools": 0.25, "semantic": 0.15, "quality": 0.35}
ESCALATION_COST, MISS_COST = 1.0, 4.0
BINS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)
TOOLS = ("query_cleaned_records", "get_summary_stats", "get_anomaly_details", "search_documents")
#: What is no department's name though it ends like one.
NO_DEPARTMENT = "哪个|哪些|四个|该|全部|各|其他|这|那|本|大|[的了是在有和与或]"
INTENTS = ("data_query", "doc_query", "hybrid")
STOP_PHRASES = ("是多少", "有多少", "多少", "怎么样", "是什么", "有哪些", "哪些", "分别", "一共", "总共", "的", "了", "吗", "呢", "啊", "呀", "请问", "帮我", "查一下", "看一下", "统计", "情况")


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def intent_accuracy(rows: DataFrame) -> DataFrame:
    """Items with an expectation, the right ones, and their share."""
    asked = F.coalesce(F.trim("expected"), F.lit("")) != ""
    right = asked & (F.col("expected") == F.col("predicted"))
    return rows.agg(F.count_if(asked).alias("n"), F.count_if(right).alias("correct")).withColumn("accuracy", _ratio(F.col("correct"), F.col("n")))


def intent_errors(rows: DataFrame) -> DataFrame:
    return rows.where("trim(coalesce(expected, '')) <> '' and not expected <=> predicted")


def tool_scores(rows: DataFrame) -> DataFrame:
    """Precision and recall of each item on sets of tools, to two places; items without an expectation are passed over."""
    want, used = F.array_distinct("expected_tools"), F.array_distinct(F.coalesce("used_tools", F.expr("cast(array() as array<string>)")))
    both = F.size(F.array_intersect(want, used))
    return rows.where("size(expected_tools) > 0").select("id", _ratio(both, F.size(used), 2).alias("precision"), _ratio(both, F.size(want), 2).alias("recall"))


def tool_means(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"))


def arg_check(rows: DataFrame) -> DataFrame:
    """Whether each expected tool has a call with all expected arguments, as trimmed text. expected_args: tool to its arguments; calls: (name, args)."""
    met = lambda tool, args: F.exists("calls", lambda c: (c["name"] == tool) & F.forall(F.map_entries(args), lambda a: F.coalesce(F.trim(a["value"]) == F.trim(c["args"].getItem(a["key"])), F.lit(False))))
    return rows.where("size(expected_args) > 0").select("id", F.forall(F.map_entries("expected_args"), lambda e: met(e["key"], e["value"])).alias("matched"))


def keyword_hit_rate(hits: DataFrame, ds: DataFrame) -> DataFrame:
    """For each item the share of its chunks that hold a keyword, to two places."""
    words = ds.where("size(keywords) > 0").select("id", "keywords")
    found = F.exists("keywords", lambda k: F.contains(F.col("content"), k))
    return hits.join(words, "id").groupBy("id").agg(F.round(F.avg(found.cast("int")), 2).alias("rate"))


def semantic_hit_rate(verdicts: DataFrame, ds: DataFrame) -> DataFrame:
    """Share of chunks judged relevant, for doc and hybrid items."""
    asked = ds.where("expected_intent in ('doc_query', 'hybrid')").select("id")
    return verdicts.join(asked, "id", "left_semi").groupBy("id").agg(F.round(F.avg(F.col("relevant").cast("int")), 2).alias("rate"))


def hit_rate_gaps(keyword: DataFrame, semantic: DataFrame, least: float = 0.4) -> DataFrame:
    both = keyword.select("id", F.col("rate").alias("keyword")).join(semantic.select("id", F.col("rate").alias("semantic")), "id").withColumn("gap", F.round(F.col("semantic") - F.col("keyword"), 2))
    return both.where(F.abs("gap") >= least).withColumn("direction", F.when(F.col("gap") > 0, "semantic_higher").otherwise("keyword_higher"))


def answer_quality(rows: DataFrame, short: int = 10) -> DataFrame:
    """Means by edge or not; an answer under ``short`` characters scores 1, a missing overall is the mean of the three."""
    brief = F.length(F.coalesce(F.trim("answer"), F.lit(""))) < short
    three = ["relevance", "completeness", "accuracy"]
    scored = rows.withColumns({c: F.when(brief, 1.0).otherwise(F.col(c)) for c in three} | {"overall": F.when(brief, 1.0).otherwise(F.coalesce("overall", F.round(sum((F.col(c) for c in three), F.lit(0.0)) / 3, 1)))})
    return scored.groupBy((F.col("category") == "edge").alias("edge")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in [*three, "overall"]))


def pipeline_diagnostics(rows: DataFrame) -> DataFrame:
    """Shares of the rule path and of escalations before and after execution, hits of each check, and rows that no check saw."""
    share = lambda c: _ratio(F.count_if(c), F.count("*"))
    check = F.col("exec_check")
    return rows.agg(
        F.count("*").alias("n"), share(F.col("path") == "rule").alias("rule_share"),
        share((F.col("mode") == "hybrid") & (F.col("intent") != "hybrid") & ~F.coalesce(check["blocked"], F.lit(False))).alias("escalated_before"),
        share(F.coalesce(check["blocked"], F.lit(False))).alias("escalated_after"),
        F.count_if(F.size(check["structure"]) > 0).alias("structure"), F.count_if(check["empty"]).alias("empty"), F.count_if(check["reference"]).alias("reference"), F.count_if(check.isNull() | ~check["vocab"]).alias("blind"),
    )


def overall_score(intent: DataFrame, tools: DataFrame, semantic: DataFrame, quality: DataFrame) -> DataFrame:
    """One row from four: accuracy, precision, rate and overall (of 5)."""
    row = intent.select("accuracy").crossJoin(tools.select("precision")).crossJoin(semantic.select("rate")).crossJoin(quality.select("overall"))
    w = WEIGHTS
    return row.withColumn("score", F.round(w["intent"] * F.col("accuracy") + w["tools"] * F.col("precision") + w["semantic"] * F.col("rate") + w["quality"] * F.col("overall") / 5, 4))


def scan_thresholds(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold, from one pass: escalations, silent errors, share of errors caught, costly misses and cost."""
    single, wrong = F.col("predicted") != "hybrid", F.col("expected") != F.col("predicted")
    costly = (F.col("expected") == "hybrid") & single

    def at(t: float) -> Column:
        up = single & (F.col("confidence") < t)
        return F.struct(F.lit(t).alias("threshold"), F.count_if(up).alias("up"), F.count_if(wrong & ~up).alias("silent"), F.count_if(wrong & up).alias("caught"), F.count_if(costly & ~up).alias("high"))

    x = rows.agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.array(*(at(t) for t in thresholds)).alias("x")).select("n", "errors", F.explode("x").alias("x")).select("n", "errors", "x.*")
    return x.select("threshold", _ratio(F.col("up"), F.col("n")).alias("escalation_rate"), "silent", _ratio(F.col("caught"), F.col("errors")).alias("caught_share"), "high", F.when(F.col("n") > 0, F.round(F.col("up") / F.col("n") * ESCALATION_COST + F.col("high") / F.col("n") * MISS_COST, 6)).otherwise(0.0).alias("cost"))


def flat_region(scan: DataFrame, slack: float = 0.05) -> DataFrame:
    """The lowest cost and the thresholds within ``slack`` of it."""
    low = scan.agg(F.min("cost").alias("lowest"))
    return scan.crossJoin(F.broadcast(low)).where(F.col("cost") <= F.col("lowest") * (1 + slack)).select("threshold", "cost", "lowest")


def calibration(rows: DataFrame) -> DataFrame:
    """Non-empty bins of confidence: count, mean confidence, accuracy and gap."""
    low = reduce(lambda c, b: F.when(F.col("confidence") >= b, b).otherwise(c), BINS[:-1], F.lit(None).cast("double"))
    out = rows.where(f"confidence < {BINS[-1]}").groupBy(low.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    return out.withColumn("gap", F.round(F.col("confidence") - F.col("accuracy"), 6))


def calibration_summary(rows: DataFrame) -> DataFrame:
    """Expected calibration error, distinct values, non-empty bins, and least, middle and largest confidence."""
    ece = calibration(rows).agg(F.round(F.sum(F.abs("gap") * F.col("n")) / F.sum("n"), 4).alias("ece"), F.count("*").alias("bins"))
    return ece.crossJoin(rows.agg(F.countDistinct("confidence").alias("values"), F.min("confidence").alias("low"), F.median("confidence").alias("middle"), F.max("confidence").alias("high")))


def join_signals(rows: DataFrame, log: DataFrame, start: Column) -> DataFrame:
    """Each row with the first log line of its question's hash at or after ``start``; misses keep nulls."""
    first = log.where(F.col("logged_at") >= start).groupBy("q_hash").agg(F.min_by(F.struct("p_top", "label_mass", "margin", "logged_at"), "logged_at").alias("s"))
    return rows.withColumn("q_hash", question_hash(F.col("question"))).join(first, "q_hash", "left").select("*", "s.*").drop("s")


def signal_separation(rows: DataFrame, signals: tuple[str, ...] = ("p_top", "label_mass", "margin")) -> DataFrame:
    """Upper median of each signal on wrong and on right rows, and the difference; places are counted by ranges of values, over many tasks."""
    long = rows.select(F.col("correct"), F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in signals))).alias("x")).select("correct", "x.*").where("v is not null")
    sizes = long.groupBy("signal", "correct").agg(F.count("*").alias("n"))
    placed = rank_in_groups(long, ["signal", "correct"], ["v"], "place").join(sizes, ["signal", "correct"])  # equal values may stand in any order
    middle = placed.where(F.col("place") == F.floor(F.col("n") / 2) + 1)
    out = middle.groupBy("signal").agg(F.max(F.when(~F.col("correct"), F.col("v"))).alias("wrong"), F.max(F.when(F.col("correct"), F.col("v"))).alias("right"))
    return out.withColumn("difference", F.round(F.col("right") - F.col("wrong"), 6))


def signal_sweep(rows: DataFrame, signal: str, thresholds: list[float]) -> DataFrame:
    """For each threshold the escalated share and the share of errors caught, from one pass."""
    at = lambda t: F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(signal) < t).alias("up"), F.count_if((F.col(signal) < t) & ~F.col("correct")).alias("caught"))
    x = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("e"), F.array(*(at(t) for t in thresholds)).alias("x")).select("n", "e", F.explode("x").alias("x"))
    return x.select("x.threshold", _ratio(F.col("x.up"), F.col("n")).alias("escalated"), _ratio(F.col("x.caught"), F.col("e")).alias("caught"))


def run_metrics(run: DataFrame) -> DataFrame:
    """Accuracy, kinds of error, rule-path rows and latencies of each run, of any size; p90 is the value at place int(.9 n)."""
    e, p, v = F.col("expected"), F.col("predicted"), F.col("latency_ms")
    sizes = run.groupBy("run").agg(F.count("*").alias("_n"), F.count("latency_ms").alias("_known"))
    rows = rank_in_groups(run, ["run"], ["latency_ms", "id"], "_i").join(sizes, "run")  # rows without a latency come first
    i, none = F.col("_i") - 1, F.col("_n") - F.col("_known")
    low, high = (F.max(F.when(i == none + F.floor((F.col("_known") - d) / 2), v)) for d in (1, 0))
    return rows.groupBy("run").agg(
        F.count("*").alias("n"), F.round(F.avg((e == p).cast("int")), 6).alias("accuracy"),
        *(F.round(F.avg(F.when(e == k, (e == p).cast("int"))), 6).alias(f"accuracy_{k}") for k in INTENTS),
        F.count_if((e != "hybrid") & (p == "hybrid")).alias("over_escalated"), F.count_if((e == "hybrid") & (p != "hybrid")).alias("missed_hybrid"),
        F.count_if((e == "doc_query") & (p == "data_query")).alias("doc_to_data"), F.count_if(F.col("path") == "rule").alias("rule_path"),
        ((low + high) / 2).alias("median_ms"), F.max(F.when(i == F.floor(F.col("_n") * 0.9), v)).alias("p90_ms"), F.max("latency_ms").alias("max_ms"),
    )


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items whose prediction changed, marked better, worse or other."""
    both = a.select("id", "expected", F.col("predicted").alias("before")).join(b.select("id", F.col("predicted").alias("after")), "id").where("not before <=> after")
    return both.withColumn("mark", F.when(F.col("after") == F.col("expected"), "better").when(F.col("before") == F.col("expected"), "worse").otherwise("other"))


def parse_self_report(c: Column) -> Column:
    """(intent, confidence 0..1 to two places) of a JSON answer, else of the first of hybrid, doc, data that stands as a word."""
    r = parse_model_json(c, "intent string, confidence double")
    word = lambda w: F.lower(c).rlike(rf"\b{w}\b")
    row = lambda intent, p: F.struct(F.lit(intent).alias("intent"), F.lit(p).alias("confidence"))
    from_text = F.when(word("hybrid"), row("hybrid", 0.6)).when(word("(doc|doc_query)"), row("doc_query", 0.6)).when(word("(data|data_query)"), row("data_query", 0.6)).otherwise(row("data_query", 0.5))
    bound = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(r["confidence"], F.lit(0.5)))), 2)
    return F.when(r["intent"].isin(*INTENTS), F.struct(r["intent"].alias("intent"), bound.alias("confidence"))).otherwise(from_text)


def _asked(c: str = "question") -> Column:
    return F.regexp_replace(F.trim(c), r"[？?]+$", "")


def dataset_qa(ds: DataFrame, short: int = 3, long: int = 200) -> DataFrame:
    """(check, n): gaps of ids, repeats after trimming question marks, texts too short or too long."""
    gaps = ds.agg(F.lit("id_gaps").alias("check"), F.coalesce(F.max("id") - F.min("id") + 1 - F.countDistinct("id"), F.lit(0)).alias("n"))
    repeats = ds.groupBy(_asked()).count().agg(F.lit("repeated"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)))
    size = F.length(F.trim("question"))
    return gaps.union(repeats).union(ds.agg(F.lit("too_short"), F.count_if(size < short))).union(ds.agg(F.lit("too_long"), F.count_if(size > long)))


def dataset_fix(ds: DataFrame) -> DataFrame:
    """Without repeats (the first id stays), ids made dense by their order.

    Ids are numbered by range partitions and their counts, so no task holds all rows.
    """
    first = ds.groupBy(_asked().alias("_q")).agg(F.min_by(F.struct(*ds.columns), "id").alias("r")).select("r.*")
    return dense_ids(first)


def dense_ids(ds: DataFrame, start: int = 1) -> DataFrame:
    width = 1 << 16
    rows = ds.withColumn("_b", F.floor(F.col("id") / width))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each 65536 ids
    return rows.join(before, "_b").withColumn("id", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("id")) - 1 + start).drop("_b", "_n", "_before")


def variant_drift(ds: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Variants that lose a number of their original, else keep under half of its entities (at least one). entities (name): of any length."""
    own = ds.where("source like 'variant_of_%'").select("id", "question", F.regexp_extract("source", r"variant_of_(\d+)", 1).cast("long").alias("origin"))
    both = own.join(ds.select(F.col("id").alias("origin"), F.col("question").alias("original")), "origin")
    numbers = F.array_distinct(F.regexp_extract_all("original", F.lit(r"(\d+)")))
    lost = F.exists(numbers, lambda n: ~F.contains(F.col("question"), n))
    if entities is None:
        return both.withColumn("reason", F.when(lost, "number_lost")).where("reason is not null").select("id", "origin", "reason")
    both = find_names(both, entities, "original", out="_named")
    kept = F.size(F.filter("_named", lambda e: F.contains(F.col("question"), e)))
    drift = F.when(lost, "number_lost").when((F.size("_named") > 0) & (kept < F.greatest(F.lit(1), F.ceil(F.size("_named") / 2))), "entity_lost")
    return both.withColumn("reason", drift).where("reason is not null").select("id", "origin", "reason")


def dataset_balance(ds: DataFrame) -> DataFrame:
    """Items, independent groups and their ratio, for each category; edge rows do not count."""
    group = F.coalesce(F.nullif(F.regexp_extract("source", r"variant_of_(\d+)", 1), F.lit("")), F.col("id").cast("string"))
    rows = ds.where("category <> 'edge'").withColumn("_g", group)
    return rows.groupBy("category").agg(F.count("*").alias("items"), F.countDistinct("_g").alias("groups")).withColumn("expansion", F.round(F.col("items") / F.col("groups"), 4))


def error_balance(ds: DataFrame, rows: DataFrame) -> DataFrame:
    """Error rate by item and by group (a group errs if any of its items does)."""
    group = F.coalesce(F.nullif(F.regexp_extract("source", r"variant_of_(\d+)", 1), F.lit("")), F.col("id").cast("string"))
    per = ds.where("category <> 'edge'").select("id", group.alias("g")).join(rows.select("id", "correct"), "id").groupBy("g").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("e"))
    return per.agg(_ratio(F.sum("e"), F.sum("n")).alias("by_item"), _ratio(F.count_if(F.col("e") > 0), F.count("*")).alias("by_group"))


def assemble_sets(blocks: DataFrame, quotas: DataFrame) -> DataFrame:
    """For each block its items, its quota and what is missing."""
    return quotas.join(blocks.groupBy("block").agg(F.count("*").alias("items")), "block", "left").na.fill(0, ["items"]).withColumn("missing", F.greatest(F.lit(0), F.col("quota") - F.col("items")))


def normal_question(c: Column) -> Column:
    """A question without stop phrases, blanks and marks: what is left of two wordings of one fact is equal."""
    return F.regexp_replace(c, "(?U)" + "|".join(STOP_PHRASES) + r"|[\s，。？！,?!、]+", "")


def near_duplicates(ds: DataFrame, least: int = 3) -> DataFrame:
    """Groups of equal normal questions of at least ``least`` characters: their ids, in one block or across blocks."""
    key = normal_question(F.col("question"))
    groups = ds.groupBy(key.alias("text")).agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.countDistinct("question").alias("texts"), F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.where(F.length("text") >= least).where("n > 1").withColumn("kind", F.when(F.col("texts") == 1, "exact").when(F.col("blocks") == 1, "in_block").otherwise("cross_block")).drop("texts")


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    key = lambda d: d.select(normal_question(F.col("question")).alias("text"))
    return key(a).intersect(key(b))


def field_checks(ds: DataFrame) -> DataFrame:
    """(id, problem) of rows that break a rule of the dataset."""
    tools = F.coalesce("expected_tools", F.expr("cast(array() as array<string>)"))
    rules = {
        "edge_with_intent": (F.col("category") == "edge") & (F.coalesce("expected_intent", F.lit("")) != ""),
        "intent_differs": (F.col("category") != "edge") & (F.coalesce("expected_intent", F.lit("")) != F.col("category")),
        "unknown_tool": ~F.forall(tools, lambda t: t.isin(*TOOLS)),
        "keywords_missing": F.col("category").isin("doc_query", "hybrid") & (F.coalesce(F.size("expected_doc_keywords"), F.lit(0)) <= 0),
    }
    return ds.select("id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())).alias("problem"))


def entity_checks(ds: DataFrame, emp_dept: DataFrame, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """(id, problem): one known employee beside departments none of which is theirs, or a department-like name that is not known, in data rows.

    emp_dept (employee, department): a staff list of any length; an employee of several departments is at home in each. A name
    is there if the question contains it.
    """
    home = emp_dept.where("employee <> ''").groupBy("employee").agg(F.collect_set("department").alias("_home"))
    known = emp_dept.select("department").union(ds.sparkSession.createDataFrame([(x,) for x in exclusions], "department string"))
    rows = find_names(find_names(ds.select("id", "question", "category"), home, "question", "employee", "_people"), known, "question", "department", "_named")
    alone = rows.where("size(_people) = 1 and size(_named) > 0").withColumn("employee", F.get("_people", F.lit(0))).join(home, "employee")
    foreign = alone.where(~F.arrays_overlap("_home", "_named")).select("id", F.lit("foreign_department").alias("problem"))
    like = F.regexp_extract_all("question", F.lit("([\\x{4e00}-\\x{9fa5}]{1,6}部)(?!门)"))
    strange = F.exists(like, lambda m: ~F.exists("_named", lambda d: F.contains(m, d)) & ~m.rlike(NO_DEPARTMENT))
    invented = rows.where("category = 'data_query'").where(strange).select("id", F.lit("invented_department").alias("problem"))
    return foreign.unionByName(invented)


def backfill_keywords(ds: DataFrame, seed: DataFrame) -> DataFrame:
    """Keywords of originals from a seed (id, keywords), of variants from their original; ``gap`` marks what is left."""
    origin = F.coalesce(F.nullif(F.regexp_extract("source", r"variant_of_(\d+)", 1), F.lit("")).cast("long"), F.col("id"))
    have = lambda c: F.when(F.size(c) > 0, F.col(c))
    base = ds.select(F.col("id").alias("_o"), have("keywords").alias("_k")).join(seed.select(F.col("id").alias("_o"), have("keywords").alias("_s")), "_o", "left").select("_o", F.coalesce("_k", "_s").alias("_base"))
    out = ds.withColumn("_o", origin).join(base, "_o", "left").withColumn("keywords", F.coalesce(have("keywords"), "_base")).drop("_o", "_base")
    return out.withColumn("gap", F.col("keywords").isNull() & F.col("category").isin("doc_query", "hybrid"))


def parse_variants(raw: DataFrame, ds: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """The first n usable lines of each answer (id, text) as new items that inherit their original's fields."""
    lines = raw.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^(?:\d+[.、)）]|[-*•])\s*", ""), r"""^["'“”「」]+|["'“”「」]+$""", ""))
    own = lines.withColumn("variant", clean).join(ds.drop("source"), "id").where((F.length("variant") >= least) & (F.col("variant") != F.col("question")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    rows = own.withColumn("nth", rank).where(F.col("nth") <= n)
    last = ds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    dense = dense_ids(rows.withColumn("origin", F.col("id")).withColumn("id", F.col("id") * (n + 1) + F.col("nth")))
    return dense.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("id")).withColumn("source", F.concat(F.lit("variant_of_"), "origin")).withColumn("question", F.col("variant")).drop("variant", "line", "pos", "nth", "_last", "origin")


def export_candidates(feedback: DataFrame, ds: DataFrame, existing: DataFrame) -> DataFrame:
    """Bad ratings whose question is not in the dataset, newest first and once each, with annotations that exist."""
    bad = feedback.where("rating = -1 and trim(question) <> ''").groupBy(F.trim("question").alias("question")).agg(F.max("created_at").alias("created_at"), F.max_by("comment", F.struct("created_at", "id")).alias("comment"), F.max("id").alias("feedback_id"))
    fresh = bad.join(ds.select(F.trim("question").alias("question")).distinct(), "question", "left_anti")
    known = existing.select("question", F.col("expected_intent").alias("_i"), F.col("status").alias("_st"))
    return fresh.join(known, "question", "left").select("question", "created_at", "comment", "feedback_id", F.coalesce("_i", F.lit("")).alias("expected_intent"), F.coalesce("_st", F.lit("pending")).alias("status")).orderBy(F.desc("created_at"), F.desc("feedback_id"))


def merge_candidates(candidates: DataFrame, ds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dataset with ready candidates that have an intent appended under continuing ids, and the candidates that stay."""
    ready = F.coalesce((F.col("status") == "ready") & (F.trim("expected_intent") != ""), F.lit(False))
    last = ds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = dense_ids(candidates.where(ready).withColumn("id", F.col("feedback_id"))).crossJoin(F.broadcast(last))
    new = new.select((F.col("_last") + F.col("id")).alias("id"), "question", "expected_intent", F.concat(F.lit("feedback_"), "feedback_id").alias("source"))
    return ds.select("id", "question", "expected_intent", "source").unionByName(new), candidates.where(~ready)
