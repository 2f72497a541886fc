"""The store of business rules: scoped, versioned, bound by quotas."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kernels import cosine_hits, cosine_top_k
from ..functions.order import rank_in_groups
from ..functions.patterns import find_names
from .retrieval import nearest
from .vector_index import VectorIndex

# Words that hint at a rule, and the thresholds of similarity.
HINTS = ("指的是", "记住", "口径", "定义", "以后", "叫做", "称为", "我们内部", "约定", "规则")
SUPERSEDE, UPDATE, DOCUMENTED, RECALL = 0.95, 0.90, 0.72, 0.75
DEPARTMENT_QUOTA, CANDIDATE_DAYS, CANDIDATE_QUOTA = 50, 90, 100


def has_rule_hint(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(HINTS)), F.lit(False))


def parse_rule_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Rules of extracted ``scope|rule`` lines, with their place; session rules and empty lines are dropped."""
    lines = df.withColumn("_l", F.split(text, r"\r\n|\n|\r")).select("*", F.posexplode("_l").alias("line_no", "_line")).drop("_l")
    line = F.trim(F.regexp_replace(F.regexp_replace("_line", r"^\s+|\s+$", ""), r"^[-*# ]+", ""))
    lines = lines.withColumn("_line", line).where("_line <> '' and _line not in ('无', '空')")
    bar = F.contains("_line", F.lit("|"))
    head, body = F.trim(F.substring_index("_line", "|", 1)), F.trim(F.expr("substring(_line, instr(_line, '|') + 1)"))
    lines = lines.select("*", bar.alias("_bar"), F.when(bar, head).otherwise("").alias("_head"), F.when(bar, body).otherwise(F.col("_line")).alias("content")).where("content <> '' and not startswith(_head, '会话') and not startswith(_head, '本次')")
    dept = F.when(F.col("_head").startswith("部门") & F.contains("_head", F.lit(":")), F.nullif(F.trim(F.expr("substring(_head, instr(_head, ':') + 1)")), F.lit("")))
    return lines.withColumn("department", dept).withColumn("scope", F.when(F.col("department").isNotNull(), "department").otherwise("global")).drop("_line", "_bar", "_head")


def admit_rules(rules: DataFrame) -> DataFrame:
    """Trimmed rules with text, of a known scope; a department rule needs its department, a global one has none."""
    out = rules.withColumn("content", F.trim("content")).where("content <> '' and scope in ('global', 'department') and (scope = 'global' or trim(coalesce(department, '')) <> '')")
    return out.withColumn("department", F.when(F.col("scope") == "department", F.trim("department")))


def similarity_score(similarity: Column) -> Column:
    return 0.5 + similarity / 2


def already_documented(rules: DataFrame, chunks: DataFrame | VectorIndex, verdicts: DataFrame | None = None, floor: float = DOCUMENTED) -> DataFrame:
    """Global rules (id, embedding) that the corpus states: one of the three nearest chunks scores the floor and, if given, a verdict (rule_id, chunk_id, stated) says so."""
    near = nearest(chunks, rules.where("scope = 'global'").select(F.col("id").alias("query_id"), "embedding"), 3).where(similarity_score(F.col("similarity")) >= floor).select(F.col("query_id").alias("rule_id"), F.col("id").alias("chunk_id"))
    near = near.join(verdicts.where("stated"), ["rule_id", "chunk_id"], "left_semi") if verdicts is not None else near
    return near.select(F.col("rule_id").alias("id")).distinct()


def skip_documented(rules: DataFrame, documented: DataFrame) -> DataFrame:
    return rules.join(documented, "id", "left_anti")


def in_force(rules: DataFrame, as_of: Column) -> DataFrame:
    """Open ends are allowed on both sides."""
    return rules.where((F.col("effective_from").isNull() | (F.col("effective_from") <= as_of)) & (F.col("effective_until").isNull() | (F.col("effective_until") >= as_of)))


def _by_ranges(rules: DataFrame, first: date | None, last: date | None, day: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rules with the ranges (_l, _p) of days from ``first`` to ``last`` that make up their intervals, and what gives a row with a day its ranges.

    A rule's interval is cut into the fewest ranges of 1, 2, 4 ... aligned days, two of a length at most, and a day lies in one range
    of each length, so the two meet by equality, once for each pair. Open ends reach as far as the days do.
    """
    span = (last - first).days + 1 if first else 0
    lengths = span.bit_length()
    start = F.greatest(F.lit(0), F.coalesce(F.datediff("effective_from", F.lit(first)), F.lit(0)))
    end = F.least(F.lit(span), F.coalesce(F.datediff("effective_until", F.lit(first)) + 1, F.lit(span)))
    piece = lambda odd, at: f"if(s.a < s.b and {odd} % 2 = 1, array(struct(j as length, {at} as place)), array())"
    ranges = f"""aggregate(sequence(0, {lengths}), struct(_a as a, _b as b, cast(array() as array<struct<length: int, place: int>>) as r),
        (s, j) -> if(s.a < s.b, struct(shiftright(s.a + 1, 1) as a, shiftright(s.b, 1) as b, concat(s.r, {piece('s.a', 's.a')}, {piece('s.b', 's.b - 1')}) as r), s), s -> s.r)"""
    cut = rules.withColumns({"_a": start, "_b": end}).where("_a < _b").withColumn("_r", F.explode(F.expr(ranges))).select(*rules.columns, F.col("_r.length").alias("_l"), F.col("_r.place").alias("_p"))

    def asked(days: DataFrame) -> DataFrame:
        numbered = days.where(F.col(day).isNotNull()).withColumn("_d", F.datediff(day, F.lit(first)))
        return numbered.select(*days.columns, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(lengths)), lambda j: F.call_function("shiftright", F.col("_d"), j))).alias("_l", "_p"))

    return cut, asked


def in_force_at(rules: DataFrame, questions: DataFrame, day: str = "as_of") -> DataFrame:
    """Each question (with a date of its own) with each rule in force on that day; bounds are inclusive, null ones are open.

    As many rows as there are such pairs; ``in_force_totals`` counts and adds without them. A question without a day meets no rule.
    """
    cut, asked = _by_ranges(rules, *questions.agg(F.min(day), F.max(day)).first(), day)
    return asked(questions).join(cut, ["_l", "_p"]).drop("_l", "_p")


def in_force_totals(rules: DataFrame, questions: DataFrame, value: str = "id", day: str = "as_of") -> DataFrame:
    """Each question that meets a rule in force on its day, with how many it meets (n) and the sum of their ``value`` (total).

    Rules are counted and added by ranges of days and the ranges of each day that is asked for are added, so no pairs are made.
    """
    cut, asked = _by_ranges(rules.select(F.col(value).alias("_v"), "effective_from", "effective_until"), *questions.agg(F.min(day), F.max(day)).first(), day)
    sums = cut.groupBy("_l", "_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_t"))
    days = asked(questions.select(day).distinct()).join(sums, ["_l", "_p"]).groupBy(day).agg(F.sum("_n").alias("n"), F.sum("_t").alias("total"))
    return questions.join(days, day)


def _pool(df: DataFrame) -> DataFrame:
    return df.withColumn("pool", F.concat_ws("\u0001", "scope", F.coalesce("department", F.lit("\u0002"))))


def nearest_rule(new: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """For each new rule the nearest one in force of the same scope and department (nulls are equal), with its score."""
    current = _pool(in_force(rules, as_of))
    asked = _pool(new).select(F.col("id").alias("query_id"), "embedding", "pool")
    hit = cosine_top_k(current, asked, 1).select(F.col("query_id").alias("id"), F.col("id").alias("old_id"), F.round(similarity_score(F.col("similarity")), 6).alias("score"))
    return new.join(hit, "id", "left")


def normal_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"[。.！!？?]+$", "")


def decide_rule(nearest: DataFrame, rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """touch, supersede or new; between the two thresholds a verdict (id, verdict) of ``update`` supersedes."""
    old = rules.select(F.col("id").alias("old_id"), F.col("content").alias("_old"))
    joined = nearest.join(old, "old_id", "left").join(verdicts.select("id", F.col("verdict").alias("_v")), "id", "left")
    same = F.col("_old").isNotNull() & (F.col("score") >= UPDATE) & (normal_text(F.col("_old")) == normal_text(F.col("content")))
    decision = F.when(same, "touch").when(F.col("score") >= SUPERSEDE, "supersede").when((F.col("score") >= UPDATE) & (F.col("_v") == "update"), "supersede").otherwise("new")
    return joined.withColumn("decision", decision).drop("_old", "_v")


def apply_rules(rules: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The next version of the store. Of several new rules that supersede one old rule the last by id does; the others are new.

    A superseded version ends the day before the new one begins; its heir takes scope, department and status.
    """
    last = F.row_number().over(Window.partitionBy("old_id", "decision").orderBy(F.desc("id")))
    d = decisions.withColumn("decision", F.when((F.col("decision") == "supersede") & (last > 1), "new").otherwise(F.col("decision")))
    start = F.to_date(now)
    touched = d.where("decision = 'touch'").select(F.col("old_id").alias("id")).distinct().withColumn("_touch", F.lit(True))
    closed = d.where("decision = 'supersede'").select(F.col("old_id").alias("id")).withColumn("_close", F.lit(True))
    kept = rules.join(touched, "id", "left").join(closed, "id", "left").withColumns({
        "effective_until": F.when(F.col("_close"), F.date_sub(start, 1)).otherwise(F.col("effective_until")),
        "updated_at": F.when(F.coalesce("_touch", "_close"), now).otherwise(F.col("updated_at")),
        "last_accessed": F.when(F.col("_touch"), now).otherwise(F.col("last_accessed")),
    }).select(rules.columns)
    heirs = d.where("decision = 'supersede'").join(rules.select(F.col("id").alias("old_id"), F.col("scope").alias("_s"), F.col("department").alias("_d"), F.col("status").alias("_st")), "old_id")
    heirs = heirs.withColumns({"scope": F.col("_s"), "department": F.col("_d"), "status": F.col("_st"), "session_id": F.when(F.col("_st") == "candidate", F.col("session_id"))})
    fresh = d.where("decision = 'new'").withColumn("status", F.lit("candidate"))
    dates = {"effective_from": start, "effective_until": F.lit(None).cast("date"), "created_at": now, "updated_at": now, "last_accessed": now}
    return kept.unionByName(heirs.withColumns(dates).select(rules.columns)).unionByName(fresh.withColumns(dates).select(rules.columns))


def demote_over_quota(rules: DataFrame, quota: int = DEPARTMENT_QUOTA) -> DataFrame:
    """Active department rules beyond the most recently used ``quota`` of their department become candidates.

    Only those are ranked; a department that holds most of them is ranked over many tasks.
    """
    active = F.coalesce((F.col("scope") == "department") & (F.col("status") == "active"), F.lit(False))
    placed = rank_in_groups(rules.where(active), ["department"], [F.desc_nulls_last("last_accessed"), F.desc("id")], "_r")
    demoted = placed.withColumn("status", F.when(F.col("_r") > quota, "candidate").otherwise(F.col("status")))
    return rules.where(~active).unionByName(demoted.select(rules.columns))


def purge_candidates(rules: DataFrame, now: Column, days: int = CANDIDATE_DAYS, quota: int = CANDIDATE_QUOTA) -> DataFrame:
    """Drops candidates not seen for ``days`` days, then all but the ``quota`` most recently used."""
    fresh = rules.where("status = 'candidate'").where(F.coalesce("last_accessed", "created_at") >= F.date_sub(F.to_date(now), days))
    kept = fresh.orderBy(F.desc_nulls_last("last_accessed"), F.desc("id")).limit(quota)
    return rules.where("status <> 'candidate'").unionByName(kept)


def visible_to_all(rules: DataFrame) -> DataFrame:
    return rules.where("status = 'active' and scope = 'global'")


def _pools(rules: DataFrame, questions: DataFrame) -> tuple[Column, DataFrame]:
    """The pool of a rule, and (query_id, embedding, pool) of the questions that may use its rules.

    Active global rules are a pool for all questions, those of a department for questions that name it, and candidates for
    their own session. The names are found by one pass over each question.
    """
    local = F.expr("status = 'active' and scope = 'department'")
    pool = F.when(F.expr("status = 'active' and scope = 'global'"), "a").when(local, F.concat(F.lit("d"), "department")).when(F.col("status") == "candidate", F.concat(F.lit("s"), "session_id"))
    asked = questions.select("query_id", "embedding", F.col("session_id").alias("_session"), F.col("text").alias("_text"))
    named = find_names(asked, rules.where(local), "_text", "department", "_names")
    own = F.concat(F.array(F.lit("a"), F.concat(F.lit("s"), "_session")), F.transform("_names", lambda n: F.concat(F.lit("d"), n)))
    return pool, named.select("query_id", "embedding", F.explode(own).alias("pool")).where("pool is not null")


def visible_counts(rules: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, n): how many rules each question may use; rules are counted by pool, so no pairs are made."""
    shared = visible_to_all(rules).count()
    pool, asked = _pools(rules, questions)
    sizes = rules.select(pool.alias("pool")).where("pool <> 'a'").groupBy("pool").agg(F.count("*").alias("_n"))
    own = asked.select("query_id", "pool").join(sizes, "pool").groupBy("query_id").agg(F.sum("_n").alias("n"))
    return questions.select("query_id").join(own, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + shared).alias("n"))


def _six_places(similarity: np.ndarray) -> np.ndarray:
    return np.round(0.5 + similarity / 2, 6)


def recall_rules(questions: DataFrame, rules: DataFrame, as_of: Column, k: int = 3, floor: float = RECALL) -> DataFrame:
    """(query_id, id, score, rank): visible rules in force that score the floor, the best k by score, ties by id.

    Every pool is searched with the cosine kernel, which keeps the best k of a task by the same rounded score.
    """
    current = in_force(rules, as_of)
    pool, asked = _pools(current, questions)
    rows = cosine_hits(current.withColumn("pool", pool).where("pool is not null"), asked, k, rounded=_six_places)
    scored = rows.withColumn("score", F.round(similarity_score(F.col("similarity")), 6)).where(F.col("score") >= floor)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def touch_recalled(rules: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    seen = hits.select("id").distinct().withColumn("_seen", F.lit(True))
    return rules.join(seen, "id", "left").withColumn("last_accessed", F.when(F.col("_seen"), now).otherwise(F.col("last_accessed"))).drop("_seen")


def rule_lines(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, lines) for a prompt, department rules with their department."""
    line = F.concat(F.lit("- "), "content", F.coalesce(F.concat(F.lit("（"), "department", F.lit("口径）")), F.lit("")))
    rows = hits.select("query_id", "id", "rank").join(rules.select("id", line.alias("l")), "id")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l"))), lambda x: x["l"]), "\n").alias("lines"))


def list_rules(rules: DataFrame, status: str | None = None, scope: str | None = None, limit: int = 100) -> DataFrame:
    out = rules.where(F.col("status") == status) if status else rules
    out = out.where(F.col("scope") == scope) if scope else out
    return out.orderBy(F.desc_nulls_last("last_accessed"), "id").limit(limit)


def approve_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("id").distinct().withColumn("_ok", F.lit(True))
    return rules.join(done, "id", "left").withColumns({"status": F.when(F.col("_ok"), "active").otherwise(F.col("status")), "session_id": F.when(F.col("_ok").isNull(), F.col("session_id"))}).drop("_ok")


def reject_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("id"), "id", "left_anti")
