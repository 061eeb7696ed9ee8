"""Queries of evaluation and telemetry over labels, orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluate, telemetry
from lodestone.runtime import table

# --- evaluation ----------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("size"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")


def field_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("quality").cast("string").alias("expected_field"), F.when(F.col("size") > 3000, "1").when(F.col("size") > 500, "0").alias("field"))
    return evaluate.confusion(rows)


def field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("quality").cast("string").alias("expected_field"), F.when(F.col("size") > 500, "1").alias("field"))
    return evaluate.field_match(rows).select("n", "matches", F.round("match_pct", 4).alias("match_pct"))


def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select((F.col("quality") == 1).alias("in_scope"), (F.col("toxic") == 0).alias("gate_passed"), F.pmod("doc_id", F.lit(4)).alias("n_hits"), (F.col("size") / 5000).alias("top_score"))
    return evaluate.rejection_metrics(rows, 0.2).select("n_out", F.round("rejected_pct", 4).alias("rejected_pct"), "n_in", F.round("false_rejected_pct", 4).alias("false_rejected_pct"))


def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("text").alias("answer"), F.array(F.lit("tion"), F.lit("ment"), F.lit("ü")).alias("keywords"))
    r = evaluate.keyword_coverage(c)
    return r.select("n_keywords", "n_found", "n_incomplete", F.round("mean_recall", 6).alias("mean_recall"), F.round("complete_pct", 4).alias("complete_pct"))


def document_hit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("lang").alias("domain"), F.col("source").alias("field"), F.array((F.col("doc_id") % 3).cast("string")).alias("expected_docs"), F.array((F.col("doc_id") % 5).cast("string"), F.lit("2")).alias("doc_ids"))
    return evaluate.document_hits(rows).select("domain", "field", "n", F.round("hit_rate", 6).alias("hit_rate"), F.col("level").cast("long").alias("level"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant text graded against the user text before it, as if that were its source."""
    c = table(spark, sf_dir, "conversations")
    a, u = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    rows = a.join(u, ["conv_id", "turn"]).withColumns(
        {"rejected": F.col("conv_id") % 7 == 0, "cited_ids": F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("B"))).otherwise(F.array(F.lit("A"))), "expected_ids": F.array(F.lit("A")), "field_text": F.substring_index("source_text", "\n", 1)}
    )
    return evaluate.grade(rows, ("the", "of", "la"), (), line=0.05, grounded=0.5)


def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("conv_id", "turn", "verdict", F.round("grounded", 3).alias("grounded"), F.round("completeness", 3).alias("completeness"))


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    k = F.col("doc_id") % 9
    verdict = F.when(F.col("toxic") == 1, evaluate.grade_out_of_scope(k < 5)).when(k < 4, evaluate.CORRECT).when(k < 6, evaluate.INCOMPLETE).when(k < 8, evaluate.WRONG).otherwise(evaluate.FALSE_REJECTION)
    return evaluate.verdict_summary(d.select("lang", verdict.alias("verdict")), ["lang"])


def claim_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    one = lambda text, status: F.struct(text.alias("claim"), F.lit(status).alias("status"))
    claims = F.array(one(F.substring_index("text", " ", 3), "unsupported"), one(F.lit("never said"), "unsupported"), one(F.col("text"), "supported"))
    rows = c.select("conv_id", "turn", evaluate.leaks(claims, F.col("text")).alias("l"), evaluate.behavior(F.when(F.col("turn") == 3, "boom"), F.col("turn") == 2, evaluate.is_rejection(F.col("text"), F.lit(False), ("Of the message",), ("thing",))).alias("behavior"))
    return rows.select("conv_id", "turn", F.col("l.unsupported").cast("long").alias("unsupported"), F.col("l.leaked").cast("long").alias("leaked"), "behavior")


def rule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = "struct<type:string,expect:string,values:array<string>,n:int>"
    make = lambda t, e=None, v=(), n=None: F.struct(F.lit(t).alias("type"), F.lit(e).cast("string").alias("expect"), F.array(*[F.lit(x) for x in v]).cast("array<string>").alias("values"), F.lit(n).cast("int").alias("n")).cast(kind)
    checks = F.array(make("no_server_error"), make("contains_any", v=("tion", "ment")), make("not_contains_any", v=("zzz", "ingere")), make("friendly_markers_min", v=("the", "of", "and"), n=2), make("mode_equals", "strict"), make("unknown"))
    cases = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("role").alias("class"), F.col("text").alias("answer"), F.lit("ANSWER").alias("behavior"), F.when(F.col("conv_id") % 11 == 0, 500).otherwise(200).alias("http"),
        F.when(F.col("conv_id") % 3 == 0, "strict").when(F.col("conv_id") % 3 == 1, "friendly").alias("mode"), F.lit(1).alias("n_evidence"), F.lit("").alias("disclaimer"), checks.alias("checks"),
    )
    return evaluate.rule_rates(evaluate.rule_checks(cases)).select("class", "n", F.round("pass_rate", 6).alias("pass_rate"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("query_id"))  # noqa: E741
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("value").alias("score"))
    r = evaluate.calibrate(l, hits)
    return r.select("min_score", "max_score", F.round("avg_score", 6).alias("avg_score"), F.size("scores").cast("long").alias("n_scores"))


def nested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    data = F.concat(F.lit('{"evidence": [{"document_id": "'), "event_type", F.lit('", "citations": [{"document_id" : "d'), (F.col("user_id") % 7).cast("string"), F.lit('"}]}], "p": '), "props", F.lit("}"))
    return e.select("event_id", F.array_join(evaluate.nested_ids(data), ",").alias("ids"))


def _run(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == half)
    return e.groupBy(F.col("event_type").alias("key")).agg(F.avg("value").alias("value")).withColumn("op", F.when(F.col("key") < "m", "<=").otherwise(">="))


def slo_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _run(spark, sf_dir, 0).select("key", F.when(F.col("key") != "view", F.col("value")).alias("value"))
    targets = _run(spark, sf_dir, 1).select("key", F.concat(F.lit("mean "), "key").alias("label"), "op", F.col("value").alias("target"), F.lit("s").alias("unit"))
    return evaluate.slo_verdicts(values, targets).select("key", "label", "op", F.round("value", 6).alias("value"), F.round("target", 6).alias("target"), "status")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_runs(_run(spark, sf_dir, 0), _run(spark, sf_dir, 1)).select("key", F.round("delta_pct", 6).alias("delta_pct"), "change")


def behavior_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = F.struct(F.when(F.col("role") == "user", "ANSWER").otherwise("CLARIFY").alias("behavior"), F.when(F.col("turn") == 0, "D0").alias("doc"))
    expected = c.groupBy(F.col("conv_id").alias("scenario_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    got = c.select(F.col("conv_id").alias("scenario_id"), F.col("turn").cast("int").alias("turn"), F.when(F.length("text") > 150, "ANSWER").otherwise("CLARIFY").alias("behavior"), F.array(F.concat(F.lit("D"), F.col("turn").cast("string"))).alias("doc_ids"))
    return evaluate.scenarios(expected, got).groupBy("expected", "got").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


# --- telemetry -----------------------------------------------------------------


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = telemetry.latency(e, "value", ["event_type"], [telemetry.slope(F.col("value"), F.col("event_id").cast("double")).alias("slope")])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "p50", "p90", "p95", "p99", "max")], F.round(F.col("slope") * 1e6, 4).alias("slope_millionths"))


def resource_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_type").alias("phase"), "ts", F.col("value").alias("api_mb"), (F.col("value") * 2).alias("llm_mb"), (F.col("value") * 3).alias("total_mb"), F.col("user_id").cast("double").alias("cpu"))
    r = telemetry.resource_phases(s)
    return r.select("phase", "samples", "api_mb_first", "api_mb_last", "api_mb_peak", F.round("api_mb_avg", 6).alias("api_mb_avg"), F.round(F.col("api_mb_slope") * 1e6, 3).alias("api_slope_millionths"), "llm_mb_peak", F.round("cpu_avg", 6).alias("cpu_avg"), "cpu_peak")


def stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = telemetry.stage_breakdown(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "max", "total")])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        (F.col("user_id") % 8).alias("level"), ok.alias("ok"), (F.col("value") > 60).alias("timed_out"), (F.col("value") / 3).alias("ttft"), F.col("value").alias("total"), F.col("ts").alias("started"), F.col("ts").alias("ended"), "ts",
        F.when(~ok, F.concat(F.lit("failed: "), "props")).alias("error"), F.col("event_type").alias("domain"), (F.col("user_id") % 3).alias("field"), (F.col("event_id") % 20).alias("n_chunks"),
    )


def load_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = telemetry.load_levels(_requests(spark, sf_dir))
    limits = telemetry.load_limits(levels, 30.0)
    out = levels.crossJoin(F.broadcast(limits))
    return out.select("level", "n", "timeouts", *[F.round(c, 6).alias(c) for c in ("success", "ttft_p95", "total_p50", "total_p95")], F.round(F.col("ok_per_s") * 1e6, 3).alias("ok_per_million_s"), "breaking_level", "max_sustainable")


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.error_kinds(_requests(spark, sf_dir))


def latency_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = telemetry.drift(_requests(spark, sf_dir), by=["domain"])
    return r.select("domain", *[F.round(c, 6).alias(c) for c in ("p95_first", "p95_last", "drift", "error_rate")])


def latency_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = telemetry.latency_cuts(_requests(spark, sf_dir))
    return r.select("domain", "field", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "under_1s", "chunks_per_s_p50")])


def request_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "chunk").when(F.col("event_type") == "click", "section").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "clarification").otherwise("evidence")
    data = F.concat(F.lit('{"text": "t'), (F.col("event_id") % 10).cast("string"), F.lit('", "document_id": "d'), (F.col("event_id") % 5).cast("string"), F.lit('"}'))
    rows = e.select(F.floor(F.col("event_id") / 4).alias("request_id"), F.col("event_id").alias("seq"), "ts", kind.alias("event"), data.alias("data"))
    r = telemetry.request_rollup(rows)
    return r.select("request_id", "done", F.round("ttft", 3).alias("ttft"), "n_chunks", "answer", "needs_clarification", F.array_join("doc_ids", ",").alias("doc_ids"))


_L = "(SELECT l.*, d.lang, d.source, length(d.text) AS size FROM labels l JOIN documents d USING (doc_id))"
_Q = "(SELECT user_id % 8 AS level, event_type <> 'error' AS ok, value > 60 AS timed_out, value / 3 AS ttft, value AS total, epoch(ts) AS t, CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error, event_type AS domain, user_id % 3 AS field, event_id % 20 AS n_chunks FROM events)"
_WORDS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda y: y NOT IN ('the', 'of', 'la'))"
_RUN = lambda h: f"(SELECT event_type AS key, avg(value) AS value, CASE WHEN event_type < 'm' THEN '<=' ELSE '>=' END AS op FROM events WHERE event_id % 2 = {h} GROUP BY event_type)"

QUERIES = {
    "field_confusion": field_confusion, "field_matches": field_matches, "rejection_rates": rejection_rates, "keyword_coverage": keyword_coverage, "document_hit_levels": document_hit_levels, "graded_answers": graded_answers,
    "verdict_summary": verdict_summary, "claim_leaks": claim_leaks, "rule_rates": rule_rates, "calibration": calibration, "nested_ids": nested_ids, "slo_verdicts": slo_verdicts, "compare_runs": compare_runs,
    "behavior_scenarios": behavior_scenarios, "latency_summary": latency_summary, "resource_phases": resource_phases, "stage_breakdown": stage_breakdown, "load_ladder": load_ladder, "error_kinds": error_kinds,
    "latency_drift": latency_drift, "latency_cuts": latency_cuts, "request_rollup": request_rollup,
}

ORACLES = {
    "field_confusion": f"SELECT CAST(quality AS VARCHAR) AS expected, CASE WHEN size > 3000 THEN '1' WHEN size > 500 THEN '0' ELSE 'NONE' END AS got, count(*) AS n FROM {_L} GROUP BY ALL",
    "field_matches": f"SELECT count(*) AS n, count(*) FILTER (quality = 1 AND size > 500) AS matches, round(avg(CASE WHEN quality = 1 AND size > 500 THEN 100.0 ELSE 0 END), 4) AS match_pct FROM {_L}",
    "rejection_rates": f"""WITH r AS (SELECT quality = 1 AS i, toxic <> 0 OR doc_id % 4 = 0 OR size / 5000 < 0.2 AS r FROM {_L})
        SELECT count(*) FILTER (NOT i) AS n_out, round(avg(CASE WHEN r THEN 100.0 ELSE 0 END) FILTER (NOT i), 4) AS rejected_pct, count(*) FILTER (i) AS n_in, round(avg(CASE WHEN r THEN 100.0 ELSE 0 END) FILTER (i), 4) AS false_rejected_pct FROM r""",
    "keyword_coverage": """WITH f AS (SELECT CAST(contains(x, 'tion') AS INT) + CAST(contains(x, 'ment') AS INT) + CAST(contains(x, 'ü') AS INT) AS k FROM (SELECT lower(text) AS x FROM conversations))
        SELECT count(*) * 3 AS n_keywords, CAST(sum(k) AS BIGINT) AS n_found, count(*) FILTER (k < 3) AS n_incomplete, round(avg(k / 3), 6) AS mean_recall, round(avg(CASE WHEN k = 3 THEN 100.0 ELSE 0 END), 4) AS complete_pct FROM f""",
    "document_hit_levels": f"""SELECT lang AS domain, source AS field, count(*) AS n, round(avg(CASE WHEN doc_id % 3 = doc_id % 5 OR doc_id % 3 = 2 THEN 1.0 ELSE 0 END), 6) AS hit_rate, CAST(grouping(lang, source) AS BIGINT) AS level FROM {_L} GROUP BY ROLLUP (lang, source)""",
    "verdict_summary": f"""WITH v AS (SELECT lang, CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 9 < 5 THEN 'r' ELSE 'l' END WHEN doc_id % 9 < 4 THEN 'd' WHEN doc_id % 9 < 6 THEN 't' WHEN doc_id % 9 < 8 THEN 's' ELSE 'n' END AS v FROM {_L}),
        c AS (SELECT lang, count(*) FILTER (v = 'd') AS dung, count(*) FILTER (v = 't') AS thieu, count(*) FILTER (v = 's') AS sai, count(*) FILTER (v = 'n') AS tu_choi_nham, count(*) FILTER (v = 'r') AS tu_choi_dung, count(*) FILTER (v = 'l') AS lot_ngoai_pham_vi, count(*) AS total FROM v GROUP BY lang)
        SELECT *, coalesce(round(dung * 100.0 / nullif(dung + thieu + sai + tu_choi_nham, 0), 1), 0) AS correct_pct, coalesce(round(tu_choi_dung * 100.0 / nullif(tu_choi_dung + lot_ngoai_pham_vi, 0), 1), 0) AS correct_rejection_pct FROM c""",
    "claim_leaks": """SELECT conv_id, turn, 2 AS unsupported, CAST(trim(array_to_string(string_split(text, ' ')[1:3], ' ')) <> '' AS BIGINT) + CAST(contains(text, 'never said') AS BIGINT) AS leaked,
        CASE WHEN turn = 3 THEN 'ERROR' WHEN turn = 2 THEN 'CLARIFY' WHEN trim(text) = '' OR contains(lower(text), 'thing') OR contains(lower(text), 'of the message') THEN 'REJECT' ELSE 'ANSWER' END AS behavior FROM conversations""",
    "rule_rates": """WITH c AS (SELECT role, conv_id % 11 <> 0 AND (contains(l, 'tion') OR contains(l, 'ment')) AND NOT (contains(l, 'zzz') OR contains(l, 'ingere'))
          AND CAST(contains(l, 'the') AS INT) + CAST(contains(l, 'of') AS INT) + CAST(contains(l, 'and') AS INT) >= 2 AND conv_id % 3 <> 1 AS ok FROM (SELECT *, lower(text) AS l FROM conversations))
        SELECT role AS class, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM c GROUP BY role""",
    "calibration": """WITH b AS (SELECT coalesce(max(value), 0) AS s FROM labels LEFT JOIN events ON user_id = doc_id WHERE quality = 0 GROUP BY doc_id) SELECT min(s) AS min_score, max(s) AS max_score, round(avg(s), 6) AS avg_score, count(*) AS n_scores FROM b""",
    "nested_ids": "SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'd' || (user_id % 7)])), ',') AS ids FROM events",
    "slo_verdicts": f"""SELECT t.key, 'mean ' || t.key AS label, t.op, CASE WHEN t.key <> 'view' THEN round(v.value, 6) END AS value, round(t.value, 6) AS target,
        CASE WHEN t.key = 'view' OR v.value IS NULL THEN 'SKIP' WHEN (t.op = '<=' AND v.value <= t.value) OR (t.op = '>=' AND v.value >= t.value) THEN 'PASS' ELSE 'FAIL' END AS status FROM {_RUN(1)} t LEFT JOIN {_RUN(0)} v USING (key)""",
    "compare_runs": f"""WITH d AS (SELECT b.key, b.op, CASE WHEN b.value = 0 THEN 0 ELSE (n.value - b.value) / b.value * 100 END AS p FROM {_RUN(0)} b JOIN {_RUN(1)} n USING (key))
        SELECT key, round(p, 6) AS delta_pct, CASE WHEN abs(p) < 2 THEN '=' WHEN (op = '<=' AND p < 0) OR (op = '>=' AND p > 0) THEN 'better' ELSE 'worse' END AS change FROM d""",
    "behavior_scenarios": """WITH r AS (SELECT CASE WHEN role = 'user' THEN 'ANSWER' ELSE 'CLARIFY' END AS expected, CASE WHEN length(text) > 150 THEN 'ANSWER' ELSE 'CLARIFY' END AS got FROM conversations)
        SELECT expected, got, count(*) AS n, count(*) FILTER (expected = got) AS passed FROM r GROUP BY ALL""",
    "latency_summary": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
        round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, CASE WHEN count(value) >= 3 AND var_pop(event_id) > 0 THEN round(regr_slope(value, event_id) * 1e6, 4) END AS slope_millionths FROM events GROUP BY event_type""",
    "resource_phases": """WITH r AS (SELECT event_type AS phase, value AS v, user_id AS c, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n, (epoch(ts) - min(epoch(ts)) OVER (PARTITION BY event_type)) / 60.0 AS m FROM events)
        SELECT phase, count(*) AS samples, arg_min(v, ts) AS api_mb_first, arg_max(v, ts) AS api_mb_last, max(v) AS api_mb_peak, round(avg(v), 6) AS api_mb_avg, round((regr_slope(v, m) FILTER (i > floor(n * 0.1))) * 1e6, 3) AS api_slope_millionths,
        max(v * 2) AS llm_mb_peak, round(avg(c), 6) AS cpu_avg, CAST(max(c) AS DOUBLE) AS cpu_peak FROM r GROUP BY phase""",
    "stage_breakdown": "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "load_ladder": f"""WITH l AS (SELECT level, count(*) AS n, count(*) FILTER (timed_out) AS timeouts, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS success, quantile_cont(ttft, 0.95) FILTER (ok) AS a, quantile_cont(total, 0.5) FILTER (ok) AS b, quantile_cont(total, 0.95) FILTER (ok) AS c,
          count(*) FILTER (ok) / (max(t) - min(t)) AS r FROM {_Q} GROUP BY level)
        SELECT level, n, timeouts, round(success, 6) AS success, round(a, 6) AS ttft_p95, round(b, 6) AS total_p50, round(c, 6) AS total_p95, round(r * 1e6, 3) AS ok_per_million_s,
        (SELECT min(level) FROM l WHERE 1 - success >= 0.5) AS breaking_level, (SELECT max(level) FROM l WHERE success = 1 AND c <= 30) AS max_sustainable FROM l""",
    "error_kinds": f"SELECT left(error, 40) AS kind, count(*) AS n FROM {_Q} WHERE error IS NOT NULL GROUP BY kind ORDER BY n DESC, kind LIMIT 8",
    "latency_drift": f"""WITH q AS (SELECT *, (t - min(t) OVER (PARTITION BY domain)) / greatest((max(t) OVER (PARTITION BY domain) - min(t) OVER (PARTITION BY domain)) / 3, 1e-9) AS k FROM {_Q}),
        g AS (SELECT domain, quantile_cont(total, 0.95) FILTER (ok AND k < 1) AS a, quantile_cont(total, 0.95) FILTER (ok AND k >= 2) AS b, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS e FROM q GROUP BY domain)
        SELECT domain, round(a, 6) AS p95_first, round(b, 6) AS p95_last, round(b / a, 6) AS drift, round(e, 6) AS error_rate FROM g""",
    "latency_cuts": f"""SELECT domain, field, count(total) AS n, round(quantile_cont(total, 0.5), 6) AS p50, round(quantile_cont(total, 0.95), 6) AS p95, round(avg(CASE WHEN total < 1 THEN 1.0 ELSE 0 END), 6) AS under_1s,
        round(quantile_cont(n_chunks / (total - ttft), 0.5) FILTER (n_chunks > 5 AND total - ttft > 0.05), 6) AS chunks_per_s_p50 FROM {_Q} GROUP BY domain, field""",
    "request_rollup": """WITH r AS (SELECT event_id // 4 AS request_id, event_id AS seq, epoch(ts) AS t, event_type AS e, 't' || (event_id % 10) AS x, 'd' || (event_id % 5) AS d FROM events)
        SELECT request_id, bool_or(e = 'purchase') AS done, round(min(t) FILTER (e IN ('view', 'click', 'purchase')) - min(t), 3) AS ttft, count(*) FILTER (e = 'view') AS n_chunks,
        coalesce(nullif(coalesce(string_agg(x, chr(10) ORDER BY seq) FILTER (e = 'click'), ''), ''), string_agg(x, '' ORDER BY seq) FILTER (e = 'view'), '') AS answer, bool_or(e = 'error') AS needs_clarification, array_to_string(list_sort(list_distinct(list(d))), ',') AS doc_ids FROM r GROUP BY request_id""",
    "graded_answers": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS src FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user'),
        l AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND len({_WORDS('x')}) > 0 AND NOT (ends_with(x, ':') AND len({_WORDS('x')}) <= 8)) AS ls,
          list_filter(list_transform(string_split_regex(regexp_replace(string_split(src, chr(10))[1], '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+|;'), lambda x: regexp_replace(x, '^[ \\-+*\\t]+|[ \\-+*\\t]+$', '', 'g')), lambda x: len({_WORDS('x')}) >= 2) AS its, {_WORDS('src')} AS sw, {_WORDS('answer')} AS aw FROM p),
        g AS (SELECT *, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: len(list_intersect({_WORDS('x')}, sw)) / len(list_distinct({_WORDS('x')})) >= 0.05)) / len(ls) ELSE 0.0 END AS grounded,
          CASE WHEN len(its) > 0 THEN len(list_filter(its, lambda x: len(list_intersect({_WORDS('x')}, aw)) / len(list_distinct({_WORDS('x')})) >= 0.6)) / len(its) ELSE 1.0 END AS completeness FROM l)
        SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'TU_CHOI_NHAM' WHEN conv_id % 5 = 0 OR grounded < 0.5 THEN 'SAI' WHEN completeness < 0.8 THEN 'THIEU' ELSE 'DUNG' END AS verdict, round(grounded, 3) AS grounded, round(completeness, 3) AS completeness FROM g""",
}
