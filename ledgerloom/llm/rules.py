"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Each rule rejects a document whose measure exceeds a cutoff. A cutoff is admitted in a stratum only
if labelled good documents show, by an exact binomial bound, that it rejects no more than its share
``alpha / rules`` of good documents there; the level ``delta`` is divided by the number of all
tests (rules x cutoffs x strata), so with probability 1 - delta every admitted cutoff keeps its
promise, and the rules of a stratum together reject at most ``alpha`` of its good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

WORD_GAP = "[\\\\x20\\\\x09-\\\\x0D]"
SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
WINDOW = 8
#: Cutoffs that each rule may take, from strict to lax.
CUTOFFS = {
    "symbol_rate": [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
    "dup_line_rate": [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75],
    "repeat_rate": [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3],
    "mean_word": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 18.0],
    "upper_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7],
    "mark_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
}
MEASURES = {
    "symbol_rate": "coalesce(n_symbols / nullif(n_words, 0), 0d)",
    "dup_line_rate": "coalesce(n_dup_lines / nullif(n_lines, 0), 0d)",
    "repeat_rate": "coalesce(n_repeat_words / nullif(n_words, 0), 0d)",
    "mean_word": "coalesce(word_chars / nullif(n_words, 0), 0d)",
    "upper_rate": "coalesce(n_upper / nullif(word_chars, 0), 0d)",
    "mark_rate": "coalesce(n_marks / nullif(n_words, 0), 0d)",
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts that rules use, for each row with an id; all within the row, without a shuffle."""
    windows = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    texts = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(lang as string), '') stratum" if "lang" in docs.columns else "'' stratum", "coalesce(text, '') text")
    counted = texts.selectExpr(
        "doc_id",
        "stratum",
        f"filter(split(text, '{WORD_GAP}+'), w -> w <> '') words",
        "cast(size(split(text, '[#*$%&|<>]', -1)) - 1 as long) n_symbols",
        "cast(size(split(text, '[A-Z]', -1)) - 1 as long) n_upper",
        "cast(size(split(text, '!', -1)) - 1 as long) n_marks",
        f"filter(split(text, '\\n'), l -> btrim(l, {SPACES}) <> '') lines",
    )
    hashed = counted.selectExpr(
        "doc_id", "stratum", "n_symbols", "n_upper", "n_marks",
        "cast(size(words) as long) n_words",
        "cast(length(array_join(words, '')) as long) word_chars",
        "cast(size(lines) as long) n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as long) n_dup_lines",
        "transform(words, w -> xxhash64(w)) h",
    )
    hashed = hashed.withColumn("windows", F.expr(f"if(size(h) < {WINDOW}, array(), transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({windows})))")).drop("h")
    # only texts in which a window repeats are sorted
    hashed = hashed.withColumn("sorted", F.expr("if(size(array_distinct(windows)) = size(windows), array(), sort_array(transform(windows, (x, i) -> struct(x as h, i as i))))")).drop("windows")
    twice = "filter(transform(sorted, (x, k) -> if((k > 0 and sorted[greatest(k - 1, 0)].h = x.h) or (k < size(sorted) - 1 and sorted[least(k + 1, size(sorted) - 1)].h = x.h), x.i, -1)), i -> i >= 0)"
    cover = f"aggregate(array_sort({twice}), struct(0L as n, 0 as upto), (s, i) -> struct(s.n + (i + {WINDOW}) - greatest(i, s.upto) as n, i + {WINDOW} as upto), s -> s.n)"
    return hashed.withColumn("n_repeat_words", F.expr(cover)).drop("sorted")


def log_gamma(z: str) -> str:
    """SQL for the logarithm of the gamma function at z >= 1 (Stirling's series after eight steps up)."""
    y = f"({z} + 8d)"
    steps = " + ".join(f"ln({z} + {k}d)" for k in range(8))
    return f"(({y} - 0.5d) * ln({y}) - {y} + 0.9189385332046727d + 1d / (12d * {y}) - 1d / (360d * power({y}, 3d)) + 1d / (1260d * power({y}, 5d)) - ({steps}))"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """log P(X <= k) for X binomial of n and p, exactly summed from k downwards; 0 where k is at or above the mean."""
    top = f"({log_gamma(f'({n} + 1d)')} - {log_gamma(f'({k} + 1d)')} - {log_gamma(f'({n} - {k} + 1d)')} + {k} * ln({p}d) + ({n} - {k}) * ln(1d - {p}d))"
    terms = f"sequence(0L, least(cast({k} as long), cast(100 + 60 * sqrt({n} * {p}d) as long)))"
    total = f"aggregate({terms}, struct(1d as t, 0d as s), (a, j) -> struct(a.t * ({k} - j) * {1 - p}d / (({n} - {k} + j + 1d) * {p}d) as t, a.s + a.t as s), a -> a.s)"
    return F.expr(f"if({k} >= {n} * {p}d, 0d, {top} + ln({total}))")


def admitted(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the strictest admitted cutoff; a stratum or rule without one is absent."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(f"cast(size(filter(array({', '.join(f'{c}d' for c in cuts)}), c -> {MEASURES[r]} > c)) as int)").alias("above")) for r, cuts in CUTOFFS.items()))).alias("x")
    counts = measured.join(good, "doc_id", "left_semi").select("stratum", rules).groupBy("stratum", "x.rule", "x.above").agg(F.count("*").alias("n"))
    # above: how many of a rule's cutoffs a document exceeds; at most a dozen rows for a stratum and rule
    seen = counts.groupBy("stratum", "rule").agg(F.sum("n").cast("double").alias("n"), F.collect_list(F.struct("above", "n")).alias("by"))
    strata = seen.select("stratum").distinct().agg(F.count("*").alias("strata"))
    grid = "map(" + ", ".join(f"'{r}', array({', '.join(f'{c}d' for c in cuts)})" for r, cuts in CUTOFFS.items()) + ")"
    tests = seen.crossJoin(F.broadcast(strata)).select("stratum", "rule", "n", "by", "strata", F.posexplode(F.expr(f"{grid}[rule]")).alias("j", "cutoff"))
    tests = tests.withColumn("k", F.expr("cast(aggregate(filter(by, b -> b.above > j), 0L, (s, b) -> s + b.n) as double)"))
    level = F.log(F.lit(delta) / (F.lit(sum(map(len, CUTOFFS.values()))) * F.col("strata")))
    passed = tests.where(binomial_tail("k", "n", alpha / len(CUTOFFS)) <= level)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, strata_bound: int = 10_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and failed_rules for each row with an id.

    Null and empty texts have no words and fail the base rules; a text of any length is measured whole within its row; rows
    that share an id are judged each, and are good documents together if any label of the id says so. A stratum without admitted cutoffs rejects by base rules alone.
    """
    measured = cut(measures(docs))
    limits = cut(admitted(measured, labels, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")))
    limits = F.broadcast(limits) if limits.count() <= strata_bound else limits
    failed = F.expr("filter(array(" + ", ".join(f"if({m} > limits['{r}'], '{r}', null)" for r, m in MEASURES.items()) + "), r -> r is not null)")
    return measured.join(limits, "stratum", "left").withColumn("failed_rules", failed).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed",
        "not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and size(failed_rules) = 0 kept",
        "array_join(failed_rules, ',') failed_rules",
    )
