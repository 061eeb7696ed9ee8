"""Claims against evidence: overlap, numbers, negation, verdicts, filtering, citations and answers from evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lists
from lodestone.functions.text import claims, is_header, meaningful_tokens, numbers, pairs_of


def overlap(claim_words: Column, evidence_words: Column) -> Column:
    """The share of a claim's distinct tokens (or pairs) that the evidence has; 0 for none."""
    own = F.array_distinct(claim_words)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, evidence_words)) / F.size(own)).otherwise(0.0)


def pair_overlap(claim_words: Column, evidence_words: Column) -> Column:
    return F.when((F.size(claim_words) < 2) | (F.size(evidence_words) < 2), 0.0).otherwise(overlap(pairs_of(claim_words), pairs_of(evidence_words)))


def number_conflict(claim_numbers: Column, evidence_numbers: Column) -> Column:
    return F.size(F.array_except(claim_numbers, evidence_numbers)) > 0


def negation_conflict(claim: Column, evidence: Column, requires: Sequence[str] = lists.REQUIRES, denies: Sequence[str] = lists.DENIES, free: Sequence[str] = lists.FREE, free_evidence: Sequence[str] = lists.FREE_EVIDENCE) -> Column:
    """Whether the claim requires what the evidence denies, or calls free what has a price of 1000 or more there."""
    c, e = F.lower(F.trim(claim)), F.lower(evidence)
    wanted = F.filter(F.transform(F.regexp_extract_all(c, F.lit(rf"(?:{'|'.join(requires)})\s+(.{{4,60}}?)(?:[,;.!\n]|$)"), F.lit(1)), lambda x: F.trim(x)), lambda p: F.length(p) >= 4)
    both = lambda text, p, d: F.contains(text, F.concat(F.lit(d), p)) | F.contains(text, F.concat(F.lit(d), F.substring(p, 1, 20)))
    denied = F.exists(wanted, lambda p: reduce(lambda a, d: a | (~both(c, p, d) & both(e, p, d)), denies, F.lit(False)))
    any_of = lambda text, words: reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
    priced = F.exists(numbers(e), lambda n: (F.length(n) > 3))
    return F.coalesce(denied | (any_of(c, free) & ~any_of(e, free_evidence) & priced), F.lit(False))


def explode_claims(answers: DataFrame, stop: Sequence[str] = lists.CLAIM_STOP, kept: Sequence[str] = lists.CLAIM_ABBREVIATIONS) -> DataFrame:
    """(query_id, claim_no, claim) of answers(query_id, answer); numbers from 1."""
    rows = answers.select("query_id", F.posexplode(claims(F.col("answer"), kept)).alias("i", "claim"))
    return rows.select("query_id", (F.col("i") + 1).alias("claim_no"), "claim")


def verify(answers: DataFrame, evidence: DataFrame, stop: Sequence[str] = lists.CLAIM_STOP, kept: Sequence[str] = lists.CLAIM_ABBREVIATIONS) -> DataFrame:
    """(query_id, claim_no, claim, header, status, conflict, score, evidence_ids) for each claim of answers(query_id, answer)
    against evidence(query_id, candidate_id, content).

    A question has a handful of evidence rows, so they travel as one array; the tokens of either side are made once.
    """
    e = F.struct(
        "candidate_id", F.coalesce("content", F.lit("")).alias("content"), meaningful_tokens(F.col("content"), stop).alias("words"), numbers(F.col("content")).alias("numbers")
    )
    held = evidence.select("query_id", e.alias("e")).groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    c = explode_claims(answers, stop, kept)
    rows = c.join(held, "query_id", "left").withColumns({"words": meaningful_tokens(F.col("claim"), stop), "numbers": numbers(F.col("claim")), "es": F.coalesce("es", F.array().cast(dict(held.dtypes)["es"]))})
    ids = F.transform("es", lambda x: x["candidate_id"])
    cited = F.filter(F.regexp_extract_all("claim", F.lit(r"(EC_\d{3})"), F.lit(1)), lambda x: F.array_contains(F.transform("es", lambda y: y["candidate_id"]), x))
    joined = lambda xs, sep: F.array_join(F.transform(xs, lambda x: x["content"]), sep)
    rows = rows.withColumns({"cited": cited, "ids": ids, "all_words": meaningful_tokens(joined(F.col("es"), "\n"), stop), "all_numbers": F.array_distinct(F.flatten(F.transform("es", lambda x: x["numbers"])))})
    pointed = F.transform("cited", lambda i: F.get(F.filter("es", lambda x: x["candidate_id"] == i), F.lit(0)))
    rows = rows.withColumn("cited_words", meaningful_tokens(joined(pointed, " \n "), stop))
    raw, pair = overlap(F.col("words"), F.col("cited_words")), pair_overlap(F.col("words"), F.col("cited_words"))
    explicit = F.when(raw >= 0.30, raw + 0.08 + F.when(pair >= 0.15, 0.07).otherwise(0.0)).when((F.size("words") <= 2) & (raw > 0), 0.35).otherwise(raw)
    each = F.transform(
        "es",
        lambda x, i: F.struct(
            (overlap(F.col("words"), x["words"]) + F.when(pair_overlap(F.col("words"), x["words"]) >= 0.15, 0.07).otherwise(0.0)).alias("score"), (-i).alias("place"), x["candidate_id"].alias("id")
        ),
    )
    best = F.array_max(F.filter(each, lambda x: x["score"] > 0))
    rows = rows.withColumns({"explicit": explicit, "best": best})
    whole, whole_pair = overlap(F.col("words"), F.col("all_words")), pair_overlap(F.col("words"), F.col("all_words"))
    single = F.coalesce("best.score", F.lit(0.0))
    combined = (F.size("cited") == 0) & (single < 0.35) & (F.size("es") > 0) & (whole >= 0.45) & (whole_pair >= 0.15)
    score = F.when(F.size("cited") > 0, F.col("explicit")).when(combined, whole).otherwise(single)
    target = F.when(F.size("cited") > 0, F.get("cited", F.lit(0))).when(combined, F.coalesce("best.id", F.get("ids", F.lit(0)))).otherwise(F.col("best.id"))
    rows = rows.withColumns({"score": score, "target": target})
    content = F.get(F.filter("es", lambda x: x["candidate_id"] == F.col("target")), F.lit(0))["content"]
    header = is_header(F.col("claim"), stop) & (F.size("es") > 0)
    numbers_off = number_conflict(F.col("numbers"), F.col("all_numbers"))
    denied = F.coalesce(negation_conflict(F.col("claim"), content), F.lit(False))
    conflict = F.when(header, F.lit(None).cast("string")).when(denied, "negation").when(numbers_off, "number")
    rows = rows.withColumns({"header": header, "conflict": conflict})
    status = F.when(F.col("header"), "supported").when(F.col("conflict").isNotNull(), "unsupported").when(F.col("score") >= 0.35, "supported").when(F.col("score") >= 0.20, "partial").otherwise("unsupported")
    chosen = F.when(F.size("cited") > 0, F.col("cited")).when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("status", status)
    named = F.when(F.col("header"), F.array(F.get("ids", F.lit(0)))).when(F.col("status") == "unsupported", none).otherwise(chosen)
    return rows.select("query_id", "claim_no", "claim", "header", "status", "conflict", F.when(F.col("header"), F.lit(None).cast("double")).otherwise(F.col("score")).alias("score"), named.alias("evidence_ids"))


def filter_answers(verdicts: DataFrame) -> DataFrame:
    """(query_id, answer, n_kept, critical): the supported claims joined by line breaks; nothing if only headers are left."""
    kept = F.sort_array(F.collect_list(F.when(F.col("status") == "supported", F.struct("claim_no", "claim"))))
    out = verdicts.groupBy("query_id").agg(kept.alias("kept"), F.bool_or(F.col("conflict").isNotNull()).alias("critical"), F.bool_or((F.col("status") == "supported") & ~F.col("header")).alias("said"))
    text = F.trim(F.array_join(F.transform("kept", lambda x: x["claim"]), "\n"))
    return out.select("query_id", F.when(F.col("said"), text).otherwise("").alias("answer"), F.when(F.col("said"), F.size("kept")).otherwise(0).alias("n_kept"), "critical")


def map_citations(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_no, citations): the evidence rows that a claim names, in its order; unknown ids are left out."""
    rows = verdicts.select("query_id", "claim_no", F.posexplode("evidence_ids").alias("pos", "candidate_id"))
    cited = F.struct("pos", "candidate_id", "document_id", "title")
    return rows.join(evidence.select("query_id", "candidate_id", "document_id", "title"), ["query_id", "candidate_id"]).groupBy("query_id", "claim_no").agg(F.sort_array(F.collect_list(cited)).alias("citations"))


def _body(content: Column, name_label: str) -> Column:
    """The content without its line that names the document."""
    return F.trim(F.array_join(F.filter(F.split(content, "\n"), lambda x: ~F.startswith(F.trim(x), F.lit(f"{name_label}:"))), "\n"))


def template_answers(evidence: DataFrame, fields: DataFrame, name_label: str = "Tên", most: int = 2) -> DataFrame:
    """(query_id, answer) for questions with one or two fields: each field's chunk of the top document (else of any), with
    its citation, under the title; no answer if a field has none. evidence has query_id, candidate_id, document_id, title,
    field, content, rank."""
    asked = fields.filter((F.size("fields") >= 1) & (F.size("fields") <= most)).select("query_id", F.size("fields").alias("n"), F.posexplode("fields").alias("pos", "field"))
    top = evidence.filter("rank = 1").select("query_id", F.col("document_id").alias("top"), F.col("title").alias("top_title"))
    rows = asked.join(evidence, ["query_id", "field"]).join(top, "query_id")
    first = Window.partitionBy("query_id", "pos").orderBy((F.col("document_id") != F.col("top")).cast("int"), "rank")
    one = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    part = F.struct("pos", F.concat(_body(F.col("content"), name_label), F.lit(" ["), F.col("candidate_id"), F.lit("]")).alias("text"))
    whole = one.groupBy("query_id", "n", "top_title").agg(F.sort_array(F.collect_list(part)).alias("parts")).filter(F.size("parts") == F.col("n"))
    return whole.select("query_id", F.concat(F.col("top_title"), F.lit(":\n"), F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).alias("answer"))


def evidence_answers(evidence: DataFrame, name_label: str = "Tên") -> DataFrame:
    """(query_id, answer): each document's general chunk (else its first), its title once, with citations."""
    first = Window.partitionBy("query_id", "document_id").orderBy((F.coalesce("field", F.lit("")) != "general").cast("int"), "rank")
    one = evidence.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    part = F.struct("rank", F.concat_ws("\n", "title", F.concat(_body(F.col("content"), name_label), F.lit(" ["), F.col("candidate_id"), F.lit("]"))).alias("text"))
    return one.groupBy("query_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("answer"))


def rewrite_follow_ups(turns: DataFrame, pronouns: Sequence[str], keywords: Sequence[str], long: int = 6, sure: float = 0.65) -> DataFrame:
    """turns(query_id, query, active, hint_title, hint_score) with resolved: a question that names a subject without a
    pronoun stays; else the active subject is added, unless a long question turns to another one."""
    low = F.lower("query")
    edge = lambda words: F.lit(False) if not words else low.rlike(r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])")
    pronoun = edge(pronouns)
    named = reduce(lambda a, k: a | F.contains(low, F.lit(k.lower())), keywords, F.lit(False))
    hint, active = F.lower(F.coalesce("hint_title", F.lit(""))), F.lower(F.coalesce("active", F.lit("")))
    turned = ~pronoun & (F.size(F.split(F.trim("query"), r"\s+")) >= long) & (F.coalesce("hint_score", F.lit(0.0)) >= sure) & (hint != "") & ~F.contains(hint, active) & ~F.contains(active, hint)
    added = F.concat(F.col("query"), F.lit(" (liên quan đến: "), F.col("active"), F.lit(")"))
    return turns.withColumn("resolved", F.when((~pronoun & named) | (active == "") | turned, F.col("query")).otherwise(added))
