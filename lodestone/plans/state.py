"""Queries of conversation state over the conversations, with neutral slot rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import slots
from lodestone.operators import dialog, verify
from lodestone.plans.texts import SLOTS, _rule
from lodestone.runtime import table
from lodestone.streaming import jobs

EPOCH = 1_704_067_200  # 2024-01-01: turns get times from here on


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages with users, times and, for assistants, evidence."""
    c = table(spark, sf_dir, "conversations")
    word = F.substring_index("text", " ", 1)
    claim = F.struct(F.when(F.col("turn") % 3 == 0, "other").otherwise("main").alias("domain"), F.concat(F.lit("D"), F.col("turn").cast("string")).alias("document_id"), word.alias("title"),
                     F.when(F.col("conv_id") % 2 == 0, F.array(F.struct(F.lit(None).cast("string").alias("document_id"), F.lit("").alias("title")), F.struct(F.lit("C1").alias("document_id"), word.alias("title")))).alias("citations"))
    return c.select(
        F.col("conv_id").alias("session_id"), F.pmod("conv_id", F.lit(20)).alias("user_id"), "turn", "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), F.when(F.col("role") == "assistant", F.array(claim)).alias("evidence"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("s", slots(F.col("content"), SLOTS))
    return m.select("session_id", "user_id", "turn", "created_at", *[F.col(f"s.{k}").alias(k) for k in (*dialog.SINGLE_SLOTS, "documents")])


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.recent_messages(messages(spark, sf_dir), 4).select("session_id", "turn", F.col("place").cast("long").alias("place"))


def active_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.active_entity(messages(spark, sf_dir), "main")


def slot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dialog.fold_slots(turns(spark, sf_dir))
    return out.select("session_id", "turn", "intent", "procedure_name", "location", "method", "applicant_type", F.array_join("documents", ",").alias("documents"))


def user_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dialog.user_memory(turns(spark, sf_dir))
    return out.select("user_id", "intent", "location", "method", F.array_join("documents", ",").alias("documents"), F.array_join("procedure_history", ",").alias("procedure_history"))


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dialog.session_list(messages(spark, sf_dir), 3)
    return out.select("user_id", "session_id", "title", "message_count", F.col("place").cast("long").alias("place"))


def message_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dialog.message_history(messages(spark, sf_dir))
    return out.select("session_id", "turn", F.col("place").cast("long").alias("place"), F.coalesce(F.get("evidence", F.lit(0))["title"], F.lit("")).alias("evidence_title"))


def context_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = dialog.latest_state(dialog.fold_slots(turns(spark, sf_dir))).select("session_id", "intent", "location", "documents")
    out = dialog.context_records(messages(spark, sf_dir), state, dialog.active_entity(messages(spark, sf_dir), "main"), 4)
    return out.select(
        "session_id", F.array_join(F.transform("recent_messages", lambda m: m["role"]), ",").alias("roles"), F.col("structured_context.intent").alias("intent"), F.size("structured_context.documents").cast("long").alias("n_documents"),
        F.col("active_entity.document_id").alias("active_document"),
    )


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    folded = dialog.fold_slots(t).select("session_id", "turn", F.col("procedure_name").alias("active"))
    rows = messages(spark, sf_dir).filter("role = 'user'").join(folded, ["session_id", "turn"])
    asked = rows.select(F.col("session_id").alias("query_id"), "turn", F.col("content").alias("query"), "active", F.lit("ingeres form").alias("hint_title"), F.lit(0.7).alias("hint_score"))
    out = verify.rewrite_follow_ups(asked, ("it", "ça", "es"), ("tionthe",))
    return out.select("query_id", "turn", F.md5("resolved").alias("resolved_md5"))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts")
    return jobs.admission_batch(e, 3, 7200.0).select("event_id", "client", "allowed")


_M = f"(SELECT conv_id AS session_id, conv_id % 20 AS user_id, turn, role, text AS content, {EPOCH} + conv_id * 1000 + turn AS tm FROM conversations)"
_S = f"""(SELECT conv_id AS session_id, conv_id % 20 AS user_id, turn, {EPOCH} + conv_id * 1000 + turn AS tm, {_rule(SLOTS.intents)} AS intent,
  CASE WHEN NOT (contains(f, 'thth') AND NOT contains(f, 'tion')) THEN {_rule(SLOTS.procedures)} END AS procedure_name, {_rule(SLOTS.locations)} AS location, {_rule(SLOTS.methods)} AS method, {_rule(SLOTS.applicants)} AS applicant_type,
  list_filter([{', '.join(_rule((d,)) for d in SLOTS.documents)}], lambda x: x IS NOT NULL) AS documents FROM (SELECT *, strip_accents(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS f FROM conversations))"""
_LAST = lambda c: f"last_value({c} IGNORE NULLS) OVER w AS {c}"
_FOLD = f"""fold AS (SELECT session_id, turn, {', '.join(_LAST(c) for c in ('intent', 'procedure_name', 'location', 'method', 'applicant_type'))} FROM s WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
  firsts AS (SELECT session_id, d, min(turn * 100 + i) AS k FROM (SELECT session_id, turn, unnest(documents) AS d, generate_subscripts(documents, 1) AS i FROM s) GROUP BY session_id, d),
  docs AS (SELECT s.session_id, s.turn, coalesce(string_agg(d, ',' ORDER BY k), '') AS documents, count(d) AS n FROM s LEFT JOIN firsts f ON f.session_id = s.session_id AND f.k < (s.turn + 1) * 100 GROUP BY s.session_id, s.turn)"""
_ACTIVE = f"""SELECT session_id, CASE WHEN turn % 3 = 0 THEN NULL WHEN session_id % 2 = 0 THEN 'C1' ELSE 'D' || turn END AS document_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE string_split(content, ' ')[1] END AS title
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) AS n FROM {_M}) WHERE n <= 4 AND role = 'assistant') WHERE k = 1"""

QUERIES = {
    "recent_messages": recent_messages, "active_entity": active_entity, "slot_fold": slot_fold, "user_memory": user_memory, "session_list": session_list, "message_history": message_history, "context_records": context_records,
    "follow_ups": follow_ups, "admission": admission,
}

ORACLES = {
    "recent_messages": f"""SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY tm) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) AS n FROM {_M}) WHERE n <= 4""",
    "active_entity": _ACTIVE,
    "slot_fold": f"WITH s AS {_S}, {_FOLD} SELECT f.session_id, f.turn, intent, procedure_name, location, method, applicant_type, documents FROM fold f JOIN docs USING (session_id, turn)",
    "user_memory": f"""WITH s AS {_S}, d AS (SELECT user_id, d, min(tm * 100 + i) AS k FROM (SELECT user_id, tm, unnest(documents) AS d, generate_subscripts(documents, 1) AS i FROM s) GROUP BY user_id, d),
        h AS (SELECT user_id, procedure_name AS p, min(tm) AS k FROM s WHERE procedure_name IS NOT NULL GROUP BY user_id, procedure_name),
        b AS (SELECT user_id, arg_max(intent, tm) FILTER (intent IS NOT NULL) AS intent, arg_max(location, tm) FILTER (location IS NOT NULL) AS location, arg_max(method, tm) FILTER (method IS NOT NULL) AS method FROM s GROUP BY user_id)
        SELECT user_id, intent, location, method, coalesce((SELECT string_agg(d, ',' ORDER BY k) FROM d WHERE d.user_id = b.user_id), '') AS documents, coalesce((SELECT string_agg(p, ',' ORDER BY k) FROM h WHERE h.user_id = b.user_id), '') AS procedure_history FROM b""",
    "session_list": f"""WITH p AS (SELECT user_id, session_id, arg_min(content, tm) FILTER (role = 'user') AS f, count(*) AS message_count, min(tm) AS tm FROM {_M} GROUP BY ALL),
        t AS (SELECT *, trim(string_split(trim(f), chr(10))[1]) AS l, row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, session_id) AS place FROM p)
        SELECT user_id, session_id, CASE WHEN coalesce(l, '') = '' THEN 'Cuộc trò chuyện mới' WHEN length(l) > 40 THEN substring(l, 1, 40) || '...' ELSE l END AS title, message_count, place FROM t WHERE place <= 3""",
    "message_history": f"""SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY tm) AS place, CASE WHEN role = 'assistant' THEN string_split(content, ' ')[1] ELSE '' END AS evidence_title FROM {_M}""",
    "context_records": f"""WITH s AS {_S}, {_FOLD}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) AS n FROM {_M}), a AS ({_ACTIVE}),
        r AS (SELECT session_id, string_agg(role, ',' ORDER BY tm) AS roles, max(turn) AS last FROM m WHERE n <= 4 GROUP BY session_id)
        SELECT r.session_id, roles, intent, n AS n_documents, a.document_id AS active_document FROM r JOIN fold f ON f.session_id = r.session_id AND f.turn = r.last JOIN docs d ON d.session_id = r.session_id AND d.turn = r.last
        LEFT JOIN a ON a.session_id = r.session_id""",
    "follow_ups": f"""WITH s AS {_S}, {_FOLD}, q AS (SELECT m.session_id, m.turn, content, procedure_name AS active, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {_M} m JOIN fold f ON f.session_id = m.session_id AND f.turn = m.turn WHERE role = 'user'),
        p AS (SELECT *, list_contains(w, 'it') OR list_contains(w, 'ça') OR list_contains(w, 'es') AS pronoun FROM q)
        SELECT session_id AS query_id, turn, md5(CASE WHEN (NOT pronoun AND contains(lower(content), 'tionthe')) OR active IS NULL OR (NOT pronoun AND len(string_split_regex(trim(content), '\\s+')) >= 6 AND active <> 'form') THEN content
          ELSE content || ' (liên quan đến: ' || active || ')' END) AS resolved_md5 FROM p""",
}
