"""Latency, resources, load and request telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.selection import percentiles, with_percentiles


def seconds_of(c: str | Column) -> Column:
    """Seconds as a number, of timestamps with or without a zone."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("double")


def latency(rows: DataFrame, c: str | Column, by: Sequence[str] = (), more: Sequence[Column] = (), prefix: str = "", shares: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """n, mean, min, percentiles (linear between neighbours) and max of each group, and the aggregates `more`; nulls don't count."""
    x = F.col(c) if isinstance(c, str) else c
    plain = [F.count(x).alias(f"{prefix}n"), F.avg(x).alias(f"{prefix}mean"), F.min(x).alias(f"{prefix}min"), F.max(x).alias(f"{prefix}max")]
    return with_percentiles(rows, [*plain, *more], {f"{prefix}p{p}": (x, p / 100) for p in shares}, by)


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def slope(y: Column, x: Column) -> Column:
    """The least-squares slope; null under three points or without spread."""
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3) & (F.var_pop(x) > 0), F.regr_slope(y, x))


def resource_phases(samples: DataFrame, memory: Sequence[str] = ("api_mb", "llm_mb", "total_mb"), skip: float = 0.1, phase: str = "phase", at: str = "ts") -> DataFrame:
    """For each phase: samples, first, last, peak and mean memory, CPU, threads, GPU peaks, least free memory; and the
    slopes in MB a minute, for which the first `skip` of the samples, by time, are left out. The time from which they count is
    found by selection, so no task holds a phase."""
    start = samples.groupBy(phase).agg(F.min(seconds_of(at)).alias("_start"))
    cut = percentiles(samples, {"_cut": (seconds_of(at), skip)}, [phase], by_rank=True)
    of = start.join(cut, start[phase].eqNullSafe(cut[phase])).select(start[phase].alias("_phase"), "_start", "_cut")
    rows = samples.join(of, F.col(phase).eqNullSafe(F.col("_phase"))).withColumn("_m", (seconds_of(at) - F.col("_start")) / 60.0)
    late = seconds_of(at) >= F.col("_cut")
    aggregates = [F.count("*").alias("samples")]
    for m in memory:
        y, x = F.when(late, F.col(m)), F.when(late, F.col("_m"))
        aggregates += [F.min_by(m, at).alias(f"{m}_first"), F.max_by(m, at).alias(f"{m}_last"), F.max(m).alias(f"{m}_peak"), F.avg(m).alias(f"{m}_avg"), slope(y, x).alias(f"{m}_slope")]
    for name, c in (("cpu_avg", "cpu"), ("cpu_peak", "cpu"), ("threads_peak", "threads"), ("gpu_mb_peak", "gpu_mb"), ("gpu_util_peak", "gpu_util"), ("avail_min", "sys_avail_mb")):
        if c in samples.columns:
            aggregates.append((F.avg(c) if name.endswith("avg") else F.min(c) if name.endswith("min") else F.max(c)).alias(name))
    return rows.groupBy(phase).agg(*aggregates)


def overall_peaks(samples: DataFrame, memory: Sequence[str] = ("api_mb", "llm_mb", "total_mb")) -> DataFrame:
    return samples.agg(*[F.max(m).alias(f"{m}_peak") for m in memory])


def stage_breakdown(rows: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    plain = [F.count(seconds).alias("n"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"), F.sum(seconds).alias("total")]
    return with_percentiles(rows, plain, {"p50": (F.col(seconds), 0.5), "p95": (F.col(seconds), 0.95)}, [stage])


def load_levels(requests: DataFrame, level: str = "level") -> DataFrame:
    """requests(level, ok, timed_out, ttft, total, started, ended) by level of concurrency."""
    ok = F.col("ok")
    wall = seconds_of(F.max("ended")) - seconds_of(F.min("started"))
    plain = [F.count("*").alias("n"), rate(F.count_if(ok), F.count("*")).alias("success"), F.count_if("timed_out").alias("timeouts"), F.try_divide(F.count_if(ok).cast("double"), wall).alias("ok_per_s")]
    ttft, total = F.when(ok, F.col("ttft")), F.when(ok, F.col("total"))
    return with_percentiles(requests, plain, {"ttft_p95": (ttft, 0.95), "total_p50": (total, 0.5), "total_p95": (total, 0.95)}, [level])


def load_limits(levels: DataFrame, slo_p95: float, level: str = "level") -> DataFrame:
    """The first level with at least half of the requests failing, and the greatest one without failures within the SLO."""
    return levels.agg(F.min(F.when(1 - F.col("success") >= 0.5, F.col(level))).alias("breaking_level"), F.max(F.when((F.col("success") == 1) & (F.col("total_p95") <= slo_p95), F.col(level))).alias("max_sustainable"))


def error_kinds(requests: DataFrame, error: str = "error", size: int = 40, most: int = 8) -> DataFrame:
    kinds = requests.filter(F.coalesce(error, F.lit("")) != "").groupBy(F.left(F.col(error), F.lit(size)).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.orderBy(F.desc("n"), "kind").limit(most)


def drift(requests: DataFrame, at: str = "ts", seconds: str = "total", ok: str = "ok", by: Sequence[str] = ()) -> DataFrame:
    """p95 of the last third of the run over p95 of the first, of good requests; and the error rate."""
    t = seconds_of(at)
    spans = requests.groupBy(*by).agg(F.min(t).alias("_b"), F.max(t).alias("_e"))
    rows = requests.join(spans, list(by)) if by else requests.crossJoin(F.broadcast(spans))
    third = (t - F.col("_b")) / F.greatest((F.col("_e") - F.col("_b")) / 3, F.lit(1e-9))
    x = F.when(F.col(ok), F.col(seconds))
    wanted = {"p95_first": (F.when(third < 1, x), 0.95), "p95_last": (F.when(third >= 2, x), 0.95)}
    out = with_percentiles(rows, [rate(F.count_if(~F.col(ok)), F.count("*")).alias("error_rate")], wanted, by)
    return out.withColumn("drift", F.try_divide("p95_last", "p95_first"))


def latency_cuts(requests: DataFrame, by: Sequence[str] = ("domain", "field"), seconds: str = "total") -> DataFrame:
    """n, p50, p95 and the share below a second for each group; chunks a second where there are over 5 chunks and 0.05 s."""
    wanted = {"p50": (F.col(seconds), 0.5), "p95": (F.col(seconds), 0.95)}
    if {"n_chunks", "ttft"} <= set(requests.columns):
        speed = F.when((F.col("n_chunks") > 5) & (F.col(seconds) - F.col("ttft") > 0.05), F.col("n_chunks") / (F.col(seconds) - F.col("ttft")))
        wanted["chunks_per_s_p50"] = (speed, 0.5)
    plain = [F.count(seconds).alias("n"), F.avg(F.when(F.col(seconds) < 1, 1.0).otherwise(0.0)).alias("under_1s")]
    return with_percentiles(requests, plain, wanted, by)


def request_columns(events: Column) -> list[Column]:
    """What is known of a request from its events, array<struct<seq, t, event, data>> in order of seq: t in seconds, data JSON."""
    field = lambda e, name: F.get_json_object(e["data"], f"$.{name}")
    text = lambda e: F.coalesce(field(e, "answer"), field(e, "text"), field(e, "content"))
    of = lambda kind: F.filter(events, lambda e: e["event"] == kind)
    parts = lambda kind, between: F.nullif(F.array_join(F.transform(of(kind), text), between), F.lit(""))
    content = F.filter(events, lambda e: e["event"].isin("chunk", "section", "done") & (F.coalesce(text(e), F.lit("")) != ""))
    start = lambda some: F.array_min(F.transform(some, lambda e: e["t"]))
    answer = F.coalesce(F.nullif(field(F.try_element_at(of("done"), F.lit(-1)), "answer"), F.lit("")), parts("section", "\n"), parts("chunk", ""), F.lit(""))
    return [
        (F.size(of("done")) > 0).alias("done"), (start(content) - start(events)).alias("ttft"), F.size(of("chunk")).cast("long").alias("n_chunks"), answer.alias("answer"), (F.size(of("clarification")) > 0).alias("needs_clarification"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(events, lambda e: document_ids(e["data"]))))).alias("doc_ids"),
    ]


def document_ids(data: Column) -> Column:
    """array<string>: the texts under a key document_id at any depth of a JSON text, with escapes decoded; none of what isn't
    JSON. A quoted key can't stand inside a text, where its quotes are escaped, so a pattern finds all and only the keys."""
    found = F.regexp_extract_all(data, F.lit(r'"document_id"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    decoded = F.transform(found, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))
    return F.when(F.try_parse_json(data).isNotNull(), decoded).otherwise(F.array().cast("array<string>"))


def request_rollup(events: DataFrame, key: str = "request_id", at: str = "ts") -> DataFrame:
    """One row for each request of events(request_id, seq, ts, event, data JSON): done, ttft, chunks, the answer (of the done
    event, else of the sections, else of the chunks), whether it asks back, and the documents it names."""
    event = F.struct("seq", seconds_of(at).alias("t"), "event", "data")
    return events.groupBy(key).agg(F.sort_array(F.collect_list(event)).alias("_events")).select(key, *request_columns(F.col("_events")))
