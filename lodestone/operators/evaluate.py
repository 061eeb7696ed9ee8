"""Evaluation of retrieval and answers over labelled cases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lists
from lodestone.functions.text import answer_lines, fold_vowels, list_items, meaningful_tokens, numbers
from lodestone.operators.telemetry import document_ids


def expected_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases(case_id, expected_docs array<string>, ...) with rank: the least chunk position, over hits(case_id, document_id,
    rank), of any expected document; null if none is found."""
    wanted = cases.select("case_id", F.explode(F.array_distinct("expected_docs")).alias("document_id"))
    found = wanted.join(hits.select("case_id", "document_id", "rank"), ["case_id", "document_id"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    return cases.join(found, "case_id", "left")


def rank_metrics(ranked: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """n, retrieval_at_k (percent) and mrr over the cases in scope; a miss counts 0."""
    at = [F.avg(F.when(F.col("rank") <= k, 100.0).otherwise(0.0)).alias(f"retrieval_at_{k}") for k in ks]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def confusion(rows: DataFrame, expected: str = "expected_field", got: str = "field") -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.coalesce(got, F.lit("NONE")).alias("got")).agg(F.count("*").alias("n"))


def field_match(rows: DataFrame, expected: str = "expected_field", got: str = "field") -> DataFrame:
    hit = F.col(expected).eqNullSafe(F.col(got))
    return rows.agg(F.count("*").alias("n"), F.count_if(hit).alias("matches"), F.avg(F.when(hit, 100.0).otherwise(0.0)).alias("match_pct"))


def rejection_metrics(rows: DataFrame, least: float) -> DataFrame:
    """rows(in_scope, gate_passed, n_hits, top_score) to the percentages of out-of-scope cases rejected and of in-scope ones
    rejected falsely; null where there is no such case."""
    rejected = ~F.col("gate_passed") | (F.col("n_hits") == 0) | (F.coalesce("top_score", F.lit(0.0)) < least)
    pct = lambda c: F.avg(F.when(c, F.when(rejected, 100.0).otherwise(0.0)))
    return rows.agg(F.count_if(~F.col("in_scope")).alias("n_out"), pct(~F.col("in_scope")).alias("rejected_pct"), F.count_if("in_scope").alias("n_in"), pct(F.col("in_scope")).alias("false_rejected_pct"))


def is_rejection(answer: Column, clarification: Column, messages: Sequence[str] = (), markers: Sequence[str] = lists.REJECTION_MARKERS) -> Column:
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    begun = [m.strip().lower()[:30] for m in messages if m.strip()]
    return F.coalesce(clarification, F.lit(False)) | (low == "") | reduce(lambda a, m: a | F.contains(low, F.lit(m)), [*markers, *begun], F.lit(False))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """The share of the keywords that the folded answer holds; null without keywords."""
    text = fold_vowels(F.coalesce(answer, F.lit("")))
    found = F.filter(keywords, lambda k: F.contains(text, fold_vowels(k)))
    return F.when(F.size(keywords) > 0, F.size(found) / F.size(keywords))


def keyword_coverage(rows: DataFrame) -> DataFrame:
    """rows(answer, keywords) to totals: keywords, those found, incomplete cases, mean recall, share complete."""
    recall = keyword_recall(F.col("answer"), F.col("keywords"))
    r = rows.withColumn("_r", recall).filter("_r is not null")
    return r.agg(
        F.sum(F.size("keywords")).alias("n_keywords"), F.sum(F.round(F.col("_r") * F.size("keywords"))).cast("long").alias("n_found"), F.count_if(F.col("_r") < 1).alias("n_incomplete"),
        F.avg("_r").alias("mean_recall"), F.avg(F.when(F.col("_r") == 1, 100.0).otherwise(0.0)).alias("complete_pct"),
    )


def document_hits(rows: DataFrame, by: Sequence[str] = ("domain", "field")) -> DataFrame:
    """rows(expected_docs, doc_ids, by...) to hit rates for all levels of by at once."""
    hit = F.coalesce(F.arrays_overlap("expected_docs", "doc_ids"), F.lit(False))
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_rate"), F.max(F.grouping_id()).alias("level"))


# The verdicts of an answer.
CORRECT, INCOMPLETE, WRONG, FALSE_REJECTION, RIGHT_REJECTION, LEAKED = "DUNG", "THIEU", "SAI", "TU_CHOI_NHAM", "TU_CHOI_DUNG", "LOT_NGOAI_PHAM_VI"


def grade(rows: DataFrame, stop: Sequence[str] = lists.CLAIM_STOP, kept: Sequence[str] = lists.CLAIM_ABBREVIATIONS, item: float = 0.6, line: float = 0.5, complete: float = 0.8, grounded: float = 0.8) -> DataFrame:
    """rows(answer, rejected, cited_ids, expected_ids, source_text, field_text) with verdict, grounded, completeness.

    SAI: only other documents are cited, a number isn't in the source, or too few lines are grounded in it; THIEU: too few
    of the field's items are in the answer; a rejection of a valid question is TU_CHOI_NHAM.
    """
    share = lambda part, whole: F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(part)))
    rows = rows.withColumns({"_s": meaningful_tokens(F.col("source_text"), stop), "_a": meaningful_tokens(F.col("answer"), stop), "_l": answer_lines(F.col("answer"), stop, kept), "_i": list_items(F.col("field_text"), stop)})
    ok_lines = F.size(F.filter("_l", lambda x: share(meaningful_tokens(x, stop), F.col("_s")) >= line))
    ok_items = F.size(F.filter("_i", lambda x: share(meaningful_tokens(x, stop), F.col("_a")) >= item))
    rows = rows.withColumns({"grounded": F.when(F.size("_l") > 0, ok_lines / F.size("_l")).otherwise(0.0), "completeness": F.when(F.size("_i") > 0, ok_items / F.size("_i")).otherwise(1.0)})
    foreign = (F.size("cited_ids") > 0) & ~F.arrays_overlap("cited_ids", "expected_ids")
    invented = F.size(F.array_except(numbers(F.col("answer")), numbers(F.col("source_text")))) > 0
    wrong = foreign | invented | (F.col("grounded") < grounded)
    verdict = F.when(F.col("rejected"), FALSE_REJECTION).when(wrong, WRONG).when(F.col("completeness") < complete, INCOMPLETE).otherwise(CORRECT)
    return rows.withColumn("verdict", verdict).drop("_s", "_a", "_l", "_i")


def grade_out_of_scope(rejected: Column) -> Column:
    return F.when(rejected, RIGHT_REJECTION).otherwise(LEAKED)


def is_out_of_scope(behavior: Column, expected_ids: Column, prefix: str = "PROC_") -> Column:
    return F.coalesce(behavior == "REJECT", F.lit(False)) | ~F.coalesce(F.exists(expected_ids, lambda x: F.startswith(F.trim(x), F.lit(prefix))), F.lit(False))


def verdict_summary(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each verdict, and the percentages of correct answers and correct rejections, to one digit."""
    names = (CORRECT, INCOMPLETE, WRONG, FALSE_REJECTION, RIGHT_REJECTION, LEAKED)
    n = {v: F.count_if(F.col("verdict") == v) for v in names}
    pct = lambda part, whole: F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))
    inside, outside = n[CORRECT] + n[INCOMPLETE] + n[WRONG] + n[FALSE_REJECTION], n[RIGHT_REJECTION] + n[LEAKED]
    return graded.groupBy(*by).agg(*[c.alias(v.lower()) for v, c in n.items()], F.count("*").alias("total"), pct(n[CORRECT], inside).alias("correct_pct"), pct(n[RIGHT_REJECTION], outside).alias("correct_rejection_pct"))


def leaks(claims: Column, answer: Column) -> Column:
    """struct<unsupported, leaked> of claims array<struct<claim, status>>: those marked unsupported, and of these the ones
    whose text still stands in the answer."""
    bad = F.filter(claims, lambda c: c["status"] == "unsupported")
    return F.struct(F.size(bad).alias("unsupported"), F.size(F.filter(bad, lambda c: (F.trim(c["claim"]) != "") & F.contains(answer, F.trim(c["claim"])))).alias("leaked"))


def behavior(error: Column, clarification: Column, rejected: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "ERROR").when(F.coalesce(clarification, F.lit(False)), "CLARIFY").when(rejected, "REJECT").otherwise("ANSWER")


def rule_checks(cases: DataFrame) -> DataFrame:
    """cases(case_id, class, answer, behavior, http, mode, n_evidence, disclaimer, checks array<struct<type, expect, values,
    n>>) with passed for each check; null where the type is unknown or its data is missing."""
    c = cases.select("*", F.explode("checks").alias("c")).drop("checks")
    low, values = F.lower(F.coalesce("answer", F.lit(""))), F.col("c.values")
    some = F.exists(values, lambda v: F.contains(low, F.lower(v)))
    passed = (
        F.when(F.col("c.type") == "no_server_error", F.col("http") < 500)
        .when(F.col("c.type") == "behavior", F.col("behavior") == F.col("c.expect"))
        .when(F.col("c.type") == "contains_any", some)
        .when(F.col("c.type") == "not_contains_any", ~some)
        .when(F.col("c.type") == "has_evidence", F.col("n_evidence") > 0)
        .when(F.col("c.type") == "disclaimer_present", F.contains(F.col("answer"), F.col("disclaimer")))
        .when(F.col("c.type") == "friendly_markers_min", F.size(F.filter(values, lambda v: F.contains(low, F.lower(v)))) >= F.col("c.n"))
        .when(F.col("c.type") == "mode_equals", F.col("mode") == F.col("c.expect"))
        .when(F.col("c.type") == "pii_not_echoed", ~F.exists(values, lambda v: F.contains(F.col("answer"), v)))
    )
    return c.select("case_id", "class", F.col("c.type").alias("check"), passed.alias("passed"))


def rule_rates(checks: DataFrame) -> DataFrame:
    """A case passes if all its checks that aren't skipped do; the rate for each class."""
    cases = checks.groupBy("class", "case_id").agg(F.every(F.coalesce("passed", F.lit(True))).alias("ok"))
    return cases.groupBy("class").agg(F.count("*").alias("n"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("pass_rate"))


def calibrate(negatives: DataFrame, hits: DataFrame) -> DataFrame:
    """min, max, avg and the sorted list of the best score of each negative question (0 without hits)."""
    best = negatives.select("query_id").join(hits.groupBy("query_id").agg(F.max("score").alias("s")), "query_id", "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    return best.agg(F.min("s").alias("min_score"), F.max("s").alias("max_score"), F.avg("s").alias("avg_score"), F.sort_array(F.collect_list("s")).alias("scores"))


def nested_ids(json: Column) -> Column:
    """Sorted distinct document ids anywhere in a JSON text."""
    return F.array_sort(F.array_distinct(document_ids(F.coalesce(json, F.lit("")))))


def slo_verdicts(values: DataFrame, targets: DataFrame) -> DataFrame:
    """values(key, value) against targets(key, label, op, target, unit): PASS, FAIL, or SKIP without a value."""
    out = targets.join(values, "key", "left")
    holds = F.when(F.col("op") == "<=", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return out.withColumn("status", F.when(F.col("value").isNull() | F.col("target").isNull(), "SKIP").when(holds, "PASS").otherwise("FAIL"))


def compare_runs(base: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs (key, value, op) by key: delta in percent (0 where the base is 0) and whether that is better."""
    b, n = base.select("key", "op", F.col("value").alias("base")), new.select("key", F.col("value").alias("new"))
    delta = F.when(F.col("base") == 0, 0.0).otherwise((F.col("new") - F.col("base")) / F.col("base") * 100)
    good = F.when(F.col("op") == "<=", F.col("delta_pct") < 0).otherwise(F.col("delta_pct") > 0)
    return b.join(n, "key").filter("base is not null and new is not null").withColumn("delta_pct", delta).withColumn("change", F.when(F.abs("delta_pct") < 2, "=").when(good, "better").otherwise("worse"))


def scenarios(expected: DataFrame, got: DataFrame) -> DataFrame:
    """expected(scenario_id, turns array<struct<behavior, doc>>) against got(scenario_id, turn, behavior, doc_ids): one row
    for each turn with passed; an ANSWER also needs its document, where one is given."""
    e = expected.select("scenario_id", F.posexplode("turns").alias("turn", "t"))
    rows = e.join(got, ["scenario_id", "turn"], "left")
    right = F.coalesce(F.col("t.behavior") == F.col("behavior"), F.lit(False))
    hit = F.col("t.doc").isNull() | F.coalesce(F.array_contains("doc_ids", F.col("t.doc")), F.lit(False))
    return rows.select("scenario_id", "turn", F.col("t.behavior").alias("expected"), F.col("behavior").alias("got"), (right & ((F.col("t.behavior") != "ANSWER") | hit)).alias("passed"))
