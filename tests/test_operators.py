"""Golden cases of single operators on small frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import kernels
from ledgerloom.operators import align, clean, documents, evaluation, lookup, report, retrieval, routing, rules
from ledgerloom.sources import landing, readers
from ledgerloom.streaming.collect import collect_stream, stream_source


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, *, row=("x",), schema="c string"):
    return spark.createDataFrame([row], schema).select(column).first()[0]


# sources

def test_csv_encodings_and_skipped_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("编号,姓名\n1,张三\n".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("编号,姓名\n1,张三\n".encode())
    (tmp_path / "c.csv").write_text('报表\n某人\n编号,姓名\n1,"张,三"\n2,李四\n')
    assert rows(readers.read_csv_source(spark, str(tmp_path / "a.csv"))) == [("1", "张三")]
    assert rows(readers.read_csv_source(spark, str(tmp_path / "b.csv"))) == [("1", "张三")]
    skipped = readers.read_csv_source(spark, str(tmp_path / "c.csv"), skip_rows=2)
    assert skipped.columns == ["编号", "姓名"] and sorted(rows(skipped)) == [("1", "张,三"), ("2", "李四")]
    with pytest.raises(ValueError):
        readers.load_source(spark, {"source_type": "xlsx", "path": "x"})


def test_documents_but_the_index(spark, tmp_path):
    for name in ("a.md", "INDEX.md", "b.txt", "c.md"):
        (tmp_path / name).write_text(f"# {name}\nline two\n")
    assert sorted(rows(readers.read_documents(spark, str(tmp_path)))) == [("a.md", "# a.md\nline two\n"), ("c.md", "# c.md\nline two\n")]


def test_documents_by_folder_pattern_and_file(spark, tmp_path):
    path = tmp_path / "a b é%20x"
    (path / "in" / "below").mkdir(parents=True)
    (path / "folder.md").mkdir()
    files = {"a.md": b"x\r\ny", "bad.md": b"\xff\xfez", "bom.md": b"\xef\xbb\xbfq", "s p+%20é#.md": b"s", "_p=q.md": b"p"}
    passed = {"INDEX.md": b"i", "empty.md": b"", "_u.md": b"u", ".h.md": b"h", "B.MD": b"n", "in/c.txt": b"t", "in/below/d.md": b"d"}
    for name, content in (files | passed | {"in/e.md": b"e"}).items():
        (path / name).write_bytes(content)
    got = lambda *x: sorted((r[0], bytes(r[1])) for r in readers.read_documents(spark, *x).selectExpr("file_name", "cast(text as binary)").collect())
    assert got(str(path)) == got(f"{path}/*.md") == sorted(files.items())
    assert got(str(path), 1) == [("e.md", b"e")] and got(str(path / "a.md")) == [("a.md", b"x\r\ny")]
    assert got(str(path / "in" / "below"), 1) == []


def test_jdbc_source_by_query_and_parts(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).withColumn("v", F.col("id") * 2).write.format("jdbc").option("url", url).options(**driver).option("dbtable", "t").mode("overwrite").save()
    except Exception as e:
        pytest.skip(f"no embedded database: {type(e).__name__}")
    got = readers.read_jdbc_source(spark, url, 'select "id", "v" from t where "id" >= 90', driver)
    assert got.agg(F.sum("v")).first()[0] == sum(2 * i for i in range(90, 100))
    assert readers.read_jdbc_source(spark, url, "t", driver, ("id", 0, 100, 4)).rdd.getNumPartitions() == 4


def test_landing_turns_nan_to_null(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "x")], "k int, v double, t string")
    got = {r.source_row_index: r.raw_data for r in landing.land_raw(df, 7, "b", "k").collect()}
    assert got == {1: {"v": None, "t": None}, 2: {"v": "1.5", "t": "x"}}
    with pytest.raises(ValueError):
        landing.export_wide(spark.createDataFrame([], "id long, data_type string, employee_name string, department string, record_date date, quality_score double, is_anomaly boolean, anomaly_reason string, business_data map<string,string>"))


def test_stream_lands_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(3):
        spark.createDataFrame([(i, "a")], "k int, v string").coalesce(1).write.mode("append").csv(src)
    for _ in range(2):
        collect_stream(stream_source(spark, src, "k int, v string", max_files=1), 1, out, ck).awaitTermination()
    landed = spark.read.parquet(out)
    assert landed.count() == 3 and landed.select("batch_id").distinct().count() == 3


# cleaning

def test_quartiles_of_the_worked_example(spark):
    four = spark.createDataFrame([("b", i, float(v)) for i, v in enumerate([1, 2, 4, 10])], "batch_id string, record_index long, v double")
    assert clean.iqr_candidates(four, ["v"]).count() == 0
    five = four.union(spark.createDataFrame([("b", 4, 80.0)], four.schema)).union(spark.createDataFrame([("flat", i, 5.0) for i in range(9)], four.schema))
    r = clean.iqr_candidates(five, ["v"]).collect()
    assert [(x.record_index, x.q1, x.q3, x.iqr, x.deviation) for x in r] == [(4, 2.0, 10.0, 8.0, 9.5)]


def test_bounded_quartiles_are_near_the_exact_ones(spark):
    df = spark.range(1001).selectExpr("'b' batch_id", "id record_index", "cast(if(id = 1000, 99999, id) as double) v")
    for approx in (False, True):
        got = clean.iqr_candidates(df, ["v"], approx=approx).collect()
        assert [r.record_index for r in got] == [1000] and abs(got[0].q1 - 250) <= 1 and abs(got[0].q3 - 750) <= 1
        assert abs(clean.basic_stats(df, ["v"], approx=approx).first()["median"] - 500) <= 1


def test_feedback_of_other_days_and_hot_questions(spark):
    traces = spark.createDataFrame([(1, "s1", "q", "2024-01-01 10:00:00"), (2, "s2", "q", "2024-01-03 10:00:00"), (3, "s1", "q", "2024-01-03 10:00:00"), (4, "s1", "other", "2024-01-02 10:00:00")], "id long, session_id string, question string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    feedback = spark.createDataFrame([(10, None, "q", "2024-01-02 00:00:00"), (11, "s1", "q", "2024-01-09 00:00:00"), (12, None, "q", "2024-01-03 10:00:00"), (13, "s9", "q", "2024-01-09 00:00:00"), (14, None, "q", "2023-01-01 00:00:00"), (15, "s2", "q", "2024-01-03 09:59:59"), (16, None, None, "2024-01-09 00:00:00")], "id long, session_id string, question string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.id: r.trace_id for r in routing.link_feedback(feedback, traces).collect()}
    assert got == {10: 1, 11: 3, 12: 3, 13: None, 14: None, 15: None, 16: None}


def test_first_row_stays_and_gaps_are_filled(spark):
    df = spark.createDataFrame([("b", 2, None, 9.0, "z"), ("b", 1, None, 1.0, "y"), ("b", 3, "k", None, None), ("b", 4, "m", 5.0, "y"), ("c", 1, None, None, None)], "batch_id string, record_index long, key string, v double, t string")
    kept = clean.dedup_keep_first(df, ["key"], "record_index")
    assert sorted((r.batch_id, r.record_index) for r in kept.collect()) == [("b", 1), ("b", 3), ("b", 4), ("c", 1)]
    again = clean.dedup_keep_first(kept, ["key"], "record_index")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
    filled = {(r.batch_id, r.record_index): (r.v, r.t) for r in clean.fill_missing(kept, ["v"], ["t"]).collect()}
    assert filled[("b", 3)] == (3.0, "y") and filled[("c", 1)] == (None, None)


def test_hundred_candidates_make_four_batches_and_a_failed_judge_leaves_them_pending(spark):
    c = spark.createDataFrame([("b", i, "f", 0, float(i), float(i)) for i in range(100)], "batch_id string, record_index long, field string, col_pos int, value double, deviation double")
    ranked = clean.rank_candidates(c)
    assert sorted(r["count"] for r in ranked.groupBy("review_batch").count().collect()) == [10, 30, 30, 30]

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        if g["review_batch"].iloc[0] == 1:
            raise RuntimeError("down")
        return pd.DataFrame({"is_anomaly": g["value"] > 50, "reason": "r"})

    v = clean.judge_batches(ranked, judge)
    assert v.count() == 100 and v.where("pending_review").count() == 30


def test_last_effective_verdict_wins(spark):
    records = spark.createDataFrame([("b", i) for i in range(4)], "batch_id string, record_index long")
    v = spark.createDataFrame([("b", 1, 0, "f", 1.0, True, False, "a"), ("b", 2, 0, "f", 1.0, True, False, "x"), ("b", 3, 0, "f", 2.0, False, True, "p"), ("b", 4, 0, "f", 2.0, False, False, "n"), ("b", 5, 1, "g", 3.0, True, False, "q"), ("b", 6, 9, "g", 3.0, True, False, "out")], "batch_id string, seq long, record_index long, field string, value double, is_anomaly boolean, pending_review boolean, reason string")
    got = {r.record_index: (r.is_anomaly, r.anomaly_status, r.pending_check_fields) for r in clean.mark_anomalies(records, v).collect()}
    assert got[0] == (False, "pending_review", ("f", 2.0)) and got[1][:2] == (True, "confirmed") and got[2][:2] == (False, "normal") and len(got) == 4


# lookup and reports

RECORD = "id long, data_type string, employee_name string, department string, record_date date, business_data map<string,string>, quality_score double, is_anomaly boolean, batch_id string, anomaly_reason string"


def test_fallback_keys_and_date_formats(spark):
    df = spark.createDataFrame([(1, "a", None, None, None, {"所属部门": " 销售部 ", "考勤日期": "soon", "日期": "2025/11/30"}, 0.0, True, "b", None), (2, "a", None, "HR", None, {"Dept": "x"}, None, False, "b", None), (3, "a", None, None, None, {}, 0.5, False, "b", None)], RECORD)
    assert [r[0] for r in df.orderBy("id").select(lookup.lookup_department()).collect()] == [" 销售部 ", "HR", ""]
    facts = report._facts(df).collect()
    assert sorted(r.department for r in facts) == sorted(["销售部", "HR", "未知部门"])
    assert [str(r.date) for r in facts if r.date] == ["2025-11-30"] and [r.quality for r in facts] == [1.0, 1.0, 0.5]
    assert [r.id for r in df.where(lookup.date_between("2025-11-01", "2025-11-30")).collect()] == [1]
    assert [r.id for r in df.where(lookup.department_is("x")).collect()] == [2]


# documents

TEXT = """# 考勤制度

| 属性 | 内容 |
|---|---|
| 文档编号 | HR-1 |
| 生效日期 | 2024年1月1日 |

引言
## 第一章
章首
### 第一条 迟到
内容一
### 第一条 迟到
内容二
---
## 第二章
没有条款的一章
## 第三章
### 附则
末"""


def test_chunks_of_a_document(spark):
    docs = documents.load_documents(spark.createDataFrame([("a.md", TEXT), ("b.md", "no heading"), ("c.md", None)], "file_name string, text string"))
    meta = {r.file_name: r for r in docs.collect()}
    assert meta["a.md"].title == "考勤制度" and str(meta["a.md"].effective_date) == "2024-01-01" and meta["b.md"].body == "no heading" and meta["b.md"].title == "未知文档"
    chunks = documents.chunk_documents(docs)
    got = {r.chunk_key: (r.chapter, r.clause_no, r.content) for r in chunks.collect()}
    assert list(got) == ["preamble:第一章", "clause:第一条 迟到", "clause:第一条 迟到#2", "chapter:第二章", "clause:附则"]
    assert got["preamble:第一章"][2] == "## 第一章\n\n引言\n章首" and got["clause:第一条 迟到#2"] == ("第一章", "第一条", "## 第一章\n\n### 第一条 迟到\n\n内容二")
    assert {r.check: r.violations for r in documents.audit_chunks(docs, chunks).collect() if r.violations} == {}
    assert documents.chunk_documents(docs, whole_doc_fallback=True).where("file_name = 'b.md'").count() == 1


def test_packing_keeps_tables_and_long_sentences():
    assert kernels.pack(["aaa", "bbb", "c" * 20, "d"], 9, "--") == ["aaa--bbb", "c" * 20, "d"]
    table = "|a|b|\n|---|---|\n" + "|1|2|\n" * 30
    assert any(table.strip() in p for p in kernels.pack_paragraphs("句一。句二！\n" + table + "尾。", 40))
    text = "一句话。" * 60
    packed = kernels.pack_paragraphs(text, 50)
    assert "".join(packed) == text and max(map(len, packed)) <= 50


@pytest.mark.parametrize("raw, want", [("2024年1月1日", "2024-01-01"), ("自 2024-01-01 起", "2024-01-01"), ("2024-02-30", None), ("另行通知", None), (None, None)])
def test_effective_dates(spark, raw, want):
    got = one(spark, documents.parse_effective_date(F.col("c")), row=(raw,))
    assert (str(got) if got else None) == want


def test_index_changes_and_reuse(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "file_name string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "file_name string, content_hash string")
    assert {r.file_name: r.change for r in documents.index_diff(cur, old).collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}
    assert not documents.needs_reindex(documents.index_diff(cur, cur)) and documents.needs_reindex(documents.index_diff(cur, cur, force=True))


def test_table_parts_with_other_headers_are_set_aside(spark):
    parts = spark.createDataFrame([("d", 1, ["a", "b"], [["1", "2"]]), ("d", 2, ["a", "b"], [["3", "4"]]), ("d", 3, ["x", "y"], [["5", "6"]])], "doc_id string, part_no int, headers array<string>, rows array<array<string>>")
    good, bad = documents.merge_table_parts(parts)
    assert sorted(str(r.row) for r in good.collect()) == ["{'a': '1', 'b': '2'}", "{'a': '3', 'b': '4'}"] and [r.part_no for r in bad.collect()] == [3]


# retrieval

def test_tokens(spark):
    assert one(spark, retrieval.tokenize(F.col("c")), row=("加班费abc 12 费",)) == ["加班", "班费", "加", "班", "费", "abc", "12", "费"]


def test_bm25_floor_and_padding(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d d"), (4, "e")], "id long, content string")
    index = retrieval.bm25_index(chunks)
    idf = {r.token: r.idf for r in index.weights.collect()}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}.items()}
    assert raw["a"] < 0 and abs(idf["a"] - 0.25 * sum(raw.values()) / 5) < 1e-9 and abs(idf["b"] - raw["b"]) < 1e-9
    hits = retrieval.bm25_search(index, spark.createDataFrame([(1, "d"), (2, "zzz")], "query_id long, text string"), chunks, 3)
    got = {(r.query_id, r["rank"]): r.id for r in hits.collect()}
    assert got == {(1, 1): 3, (1, 2): 1, (1, 3): 2, (2, 1): 1, (2, 2): 2, (2, 3): 3}


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 99, 2), (1, 9, 3)], "query_id long, id long, rank int")
    got = [(r.id, r.score) for r in retrieval.rrf(a, b, spark.createDataFrame([(7,), (8,), (9,)], "id long")).orderBy("rank").collect()]
    assert got == [(7, round(2 / 61, 4)), (8, round(1 / 62, 4)), (9, round(1 / 62, 4))]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(5, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.id, r.score) for r in retrieval.vector_search(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]


def test_long_chapters_give_only_neighbours(spark):
    chunks = spark.createDataFrame([(i, "f", "chapter:c", i, "c", "" if i == 0 else f"第{i}条", f"## c\n\nbody{i} " + "x" * 100) for i in range(8)] + [(50, "f", "", 9, "", "", "loose")], "id long, file_name string, parent_key string, chunk_index int, chapter string, section string, content string")
    hits = spark.createDataFrame([(1, 4, 1), (1, 50, 2)], "query_id long, id long, rank int")
    small = retrieval.build_context(hits, chunks, 300).first().context
    assert [f"body{i}" in small for i in range(8)] == [True, False, False, True, True, True, False, False] and small.endswith("[来源2] loose")
    assert all(f"body{i}" in retrieval.build_context(hits, chunks, 5000).first().context for i in range(8))
    assert retrieval.audit_context(retrieval.build_context(hits, chunks), hits, chunks).first().lost == 0


# rules

def test_rule_lines(spark):
    text = "通用|合同额指含税合同金额\n部门:销售部|按签约额算\n会话|本次只统计华东区\n部门:|x\n- 没有竖线\n无\n部门:财务|"
    got = [(r.scope, r.department, r.content) for r in rules.parse_rule_lines(spark.createDataFrame([(text,)], "text string")).orderBy("line_no").collect()]
    assert got == [("global", None, "合同额指含税合同金额"), ("department", "销售部", "按签约额算"), ("global", None, "x"), ("global", None, "没有竖线")]


RULE = "id long, content string, embedding array<float>, scope string, department string, status string, session_id string, effective_from date, effective_until date, created_at timestamp, updated_at timestamp, last_accessed timestamp"


def _rule(i, content, v, status="active", session=None):
    return (i, content, v, "global", None, status, session, None, None, None, None, None)


def test_a_new_version_closes_the_old_one(spark):
    now = F.lit("2024-06-30 08:00:00").cast("timestamp")
    store = spark.createDataFrame([_rule(1, "合同额含税。", [1.0, 0.0]), _rule(2, "b", [0.0, 1.0])], RULE)
    new = spark.createDataFrame([_rule(11, "合同额 含税", [1.0, 0.0]), _rule(12, "合同额不含税", [1.0, 0.05]), _rule(13, "c", [0.7, 0.7]), _rule(14, "d", [0.06, 1.0])], RULE)
    near = rules.nearest_rule(new, store, F.to_date(now))
    decided = rules.decide_rule(near, store, spark.createDataFrame([(14, "different")], "id long, verdict string"))
    assert {r.id: r.decision for r in decided.collect()} == {11: "touch", 12: "supersede", 13: "new", 14: "supersede"}
    after = {r.id: r for r in rules.apply_rules(store, decided, now).collect()}
    assert str(after[1].effective_until) == "2024-06-29" and str(after[12].effective_from) == "2024-06-30" and after[12].status == "active" and after[13].status == "candidate" and len(after) == 5
    assert [r.id for r in rules.in_force(spark.createDataFrame(list(after.values()), RULE), F.lit("2024-06-30").cast("date")).orderBy("id").collect()] == [12, 13, 14]


# routing

@pytest.mark.parametrize("p, want", [({"数": 0.8, "文": 0.15, "混": 0.05}, ("data_query", 0.8, 1.0, 0.65)), ({"数": 0.3, "文": 0.2}, ("data_query", 0.3, 0.5, 0.1)), ({"答": 0.5, "文": 0.35, "数": 0.1}, ("doc_query", 0.35, 0.45, 0.15)), ({"答": 0.6, "案": 0.4}, None)])
def test_signals(spark, p, want):
    got = one(spark, routing.derive_signals(F.col("c")), row=({k: math.log(v) for k, v in p.items()},), schema="c map<string,double>")
    assert want is None and got is None or (got.intent, *(round(x, 6) for x in (got.p_top, got.label_mass, got.margin))) == want


@pytest.mark.parametrize("q, want", [("销售部11月的异常率是多少", ("data_query", 0.6)), ("郑十最近怎么样", ("data_query", 0.3)), ("销售部加班异常率这个指标，制度里怎么规定的", ("hybrid", 0.65))])
def test_key_words(spark, q, want):
    assert tuple(one(spark, routing.rule_classify(F.col("c")), row=(q,))) == want


def test_execution_checks(spark):
    cases = [("a", "有哪些产品", "没有匹配的数据记录", [("t", {"data_type": "products"})]), ("b", "x", "42", [("t", {"department": "市场部"})]), ("c", "有哪些员工", "没有匹配的数据记录", []), ("d", "多不多", "暂无数据可统计", [("t", {"data_type": "sales"})]), ("e", "为什么", "42", [])]
    traces = spark.createDataFrame([(*c, "agent") for c in cases], "trace_id string, question string, answer string, tool_calls array<struct<name:string,args:map<string,string>>>, mode string")
    vocab = spark.createDataFrame([("data_type", "sales"), ("department", "销售部")], "kind string, value string")
    got = {r.trace_id: (len(r.exec_check.structure), r.exec_check.empty, r.exec_check.reference, r.exec_check.blocked, r.mode) for r in routing.inspect_execution(traces, vocab).collect()}
    assert got == {"a": (1, False, False, True, "hybrid"), "b": (1, False, False, True, "hybrid"), "c": (0, True, False, True, "hybrid"), "d": (0, False, False, False, "agent"), "e": (0, False, True, False, "agent")}
    none = routing.inspect_execution(traces, vocab.where("false")).where("trace_id = 'a'").first().exec_check
    assert not none.vocab and none.structure == [] and none.empty


# evaluation

def test_empty_bins_and_edges(spark):
    r = spark.createDataFrame([(1.0, True), (0.5, False), (0.55, True), (0.9, True)], "confidence double, correct boolean")
    assert {x.bin: x.n for x in evaluation.calibration(r).collect()} == {0.5: 2, 0.9: 2}
    assert evaluation.intent_accuracy(spark.createDataFrame([("", "a"), (None, "b")], "expected string, predicted string")).first().accuracy == 0.0


def test_dataset_repeats_and_dense_ids(spark):
    ds = spark.createDataFrame([(1, "几条？"), (5, "几条"), (70000, "别的"), (140000, "z")], "id long, question string")
    assert {r.check: r.n for r in evaluation.dataset_qa(ds).collect()} == {"id_gaps": 139996, "repeated": 1, "too_short": 3, "too_long": 0}
    assert sorted(rows(evaluation.dataset_fix(ds))) == [(1, "几条？"), (2, "别的"), (3, "z")]


def test_headers_and_types(spark):
    assert one(spark, align.infer_data_type(F.col("c")), row=("Sales 客户",)) == "sales"
    h = spark.createDataFrame([(1, 0, "所属部门"), (1, 1, "部门"), (1, 2, "备注")], "source_id int, pos int, header string")
    r = align.align_headers(h, align.synonyms(spark)).first()
    assert r.mapping == {"所属部门": "department"} and r.unmapped == ["部门", "备注"]
