"""Conversation state: recent messages, the active entity, slot folds, session lists and context records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SINGLE_SLOTS = ("intent", "procedure_name", "location", "method", "fee", "processing_time", "applicant_type")


def recent_messages(messages: DataFrame, n: int = 20, session: str = "session_id", at: str = "created_at") -> DataFrame:
    """The n latest messages of each session, with place (1 is the oldest of them)."""
    late = Window.partitionBy(session).orderBy(F.desc(at))
    kept = messages.withColumn("_n", F.row_number().over(late)).filter(F.col("_n") <= n)
    return kept.withColumn("place", F.max("_n").over(Window.partitionBy(session)) - F.col("_n") + 1).drop("_n")


def active_entity(messages: DataFrame, domain: str | None = None, window: int = 4, session: str = "session_id", at: str = "created_at") -> DataFrame:
    """(session_id, document_id, title): of the newest assistant message with evidence among the latest ones, the first
    citation (else the claim itself) that has a title or an id; null if that message is of another domain. messages has
    role and evidence array<struct<domain, document_id, title, citations array<struct<document_id, title>>>>."""
    latest = recent_messages(messages, window, session, at).filter((F.col("role") == "assistant") & (F.size("evidence") > 0))
    newest = latest.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("place")))).filter("_n = 1")
    named = lambda x: (F.coalesce(x["title"], F.lit("")) != "") | (F.coalesce(x["document_id"], F.lit("")) != "")
    pair = lambda x: F.struct(x["document_id"].alias("document_id"), x["title"].alias("title"))
    each = F.flatten(F.transform("evidence", lambda e: F.concat(F.coalesce(F.transform(e["citations"], pair), F.array().cast("array<struct<document_id:string,title:string>>")), F.array(pair(e)))))
    first = F.get(F.filter(each, named), F.lit(0))
    other = F.exists("evidence", lambda e: F.coalesce(e["domain"], F.lit(domain or "")) != F.lit(domain)) if domain else F.lit(False)
    out = newest.select(session, F.when(~other, first).alias("a"))
    return out.select(session, F.col("a.document_id").alias("document_id"), F.col("a.title").alias("title"))


def fold_slots(turns: DataFrame, key: str = "session_id", order: Sequence[str] = ("turn",), slots: Sequence[str] = SINGLE_SLOTS) -> DataFrame:
    """turns(key, order, slots..., documents array<string>) with each slot's last value so far and all documents so far in
    the order in which they came.

    Documents aren't collected anew for each turn: each counts at its first turn only, and a turn carries the running
    list of those firsts.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("_t", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    firsts = numbered.select(key, "_t", F.posexplode("documents").alias("_p", "_d")).groupBy(key, "_d").agg(F.min(F.struct("_t", "_p")).alias("_f"))
    new = firsts.groupBy(key, F.col("_f._t").alias("_t")).agg(F.sort_array(F.collect_list(F.struct(F.col("_f._p").alias("p"), F.col("_d").alias("d")))).alias("_new"))
    rows = numbered.join(new, [key, "_t"], "left").withColumn("_new", F.transform(F.coalesce("_new", F.array().cast("array<struct<p:int,d:string>>")), lambda x: x["d"]))
    held = {s: F.last(s, ignorenulls=True).over(so_far) for s in slots}
    return rows.withColumns({**held, "documents": F.flatten(F.collect_list("_new").over(so_far))}).drop("_t", "_new")


def latest_state(folded: DataFrame, key: str = "session_id", order: Sequence[str] = ("turn",)) -> DataFrame:
    last = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return folded.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def user_memory(turns: DataFrame, user: str = "user_id", order: Sequence[str] = ("created_at", "session_id", "turn"), slots: Sequence[str] = SINGLE_SLOTS) -> DataFrame:
    """One row for each user over all sessions: the last value of each slot, all documents, and procedure_history, the
    distinct procedures in the order in which they came."""
    last = [F.max_by(s, F.when(F.col(s).isNotNull(), F.struct(*order))).alias(s) for s in slots]
    base = turns.groupBy(user).agg(*last)

    def ordered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(user, "v").agg(F.min("k").alias("k")).groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(name))

    docs = turns.select(user, F.struct(*order).alias("o"), F.posexplode("documents").alias("p", "v")).select(user, F.struct("o", "p").alias("k"), "v")
    history = turns.filter("procedure_name is not null").select(user, F.struct(*order).alias("k"), F.col("procedure_name").alias("v"))
    out = base.join(ordered(docs, "documents"), user, "left").join(ordered(history, "procedure_history"), user, "left")
    return out.na.fill({}).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("documents", "procedure_history")})


def session_list(messages: DataFrame, newest: int = 30, longest: int = 40, default: str = "Cuộc trò chuyện mới", session: str = "session_id", user: str = "user_id", at: str = "created_at") -> DataFrame:
    """(user_id, session_id, title, message_count, created_at, place): the newest sessions of each user. The title is the
    first line of the first user message, cut."""
    first = F.min_by("content", F.when((F.col("role") == "user"), F.col(at)))
    per = messages.groupBy(user, session).agg(first.alias("first"), F.count("*").alias("message_count"), F.min(at).alias("created_at"))
    line = F.trim(F.substring_index(F.trim("first"), "\n", 1))
    title = F.when(F.coalesce(line, F.lit("")) == "", F.lit(default)).when(F.length(line) > longest, F.concat(F.substring(line, 1, longest), F.lit("..."))).otherwise(line)
    order = Window.partitionBy(user).orderBy(F.desc("created_at"), session)
    return per.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= newest).select(user, session, title.alias("title"), "message_count", "created_at", "place")


def message_history(messages: DataFrame, session: str = "session_id", at: str = "created_at") -> DataFrame:
    """Messages with place in their session; evidence for assistants only."""
    return messages.withColumns({"place": F.row_number().over(Window.partitionBy(session).orderBy(at)), "evidence": F.when(F.col("role") == "assistant", F.col("evidence"))})


def context_records(messages: DataFrame, state: DataFrame, active: DataFrame, n: int = 20, session: str = "session_id", at: str = "created_at") -> DataFrame:
    """One nested record for each session: its latest messages in order, its slots and its active entity."""
    one = F.struct("place", "role", "content")
    recent = recent_messages(messages, n, session, at).groupBy(session).agg(F.sort_array(F.collect_list(one)).alias("recent_messages"))
    slots = state.select(session, F.struct(*[c for c in state.columns if c != session]).alias("structured_context"))
    named = active.select(session, F.struct("document_id", "title").alias("active_entity"))
    return recent.join(slots, session, "left").join(named, session, "left")
