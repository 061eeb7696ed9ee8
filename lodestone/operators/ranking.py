"""Scoring of candidates, scope gates, choice of documents and chunks, reranking, mentions and sub-questions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lists
from lodestone.functions.text import LEFT, RIGHT, distinctive_tokens, expand_abbreviations, fold_vowels, is_negated, is_vague, runs_of, subject_tokens, tokens
from lodestone.runtime import scratch

# --- bonuses -----------------------------------------------------------------


def keyword_bonus(query: Column, title: Column, content: Column, stop: Sequence[str] = lists.SUBJECT_STOP, abbreviations: Sequence = lists.ABBREVIATIONS) -> Column:
    """0.30 for each subject token shared with the title (unless the question denies it), 0.03 with the content."""
    q = subject_tokens(query, stop, abbreviations)
    shared = lambda c: F.size(F.array_intersect(q, subject_tokens(c, stop, abbreviations)))
    return F.when(is_negated(title, query), F.lit(0.0)).otherwise(shared(title) * 0.30) + shared(content) * 0.03


def alias_bonus(query: Column, aliases: Column, stop: Sequence[str] = lists.SUBJECT_STOP, abbreviations: Sequence = lists.ABBREVIATIONS) -> Column:
    """The best alias's bonus: contained 0.85, all its words 0.55, two of them 0.25."""
    q = F.lower(expand_abbreviations(query, abbreviations))
    qf, words = fold_vowels(q), subject_tokens(query, stop, abbreviations)

    def one(a: Column) -> Column:
        af, aw = fold_vowels(a), subject_tokens(a, stop, abbreviations)
        inside = F.contains(q, a) | ((F.length(af) >= 4) & F.contains(qf, af))
        shared = F.size(F.array_intersect(aw, words))
        worth = F.when(inside, 0.85).when((F.size(aw) > 0) & (shared == F.size(aw)), 0.55).when(shared >= 2, 0.25).otherwise(0.0)
        return F.when((a == "") | is_negated(a, q), 0.0).otherwise(worth)

    return F.coalesce(F.array_max(F.transform(aliases, one)), F.lit(0.0))


def context_bonus(active: Column, location: Column, title: Column, content: Column) -> Column:
    where = F.lower(F.concat_ws(" ", title, content))
    hit = lambda c, w: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.when(F.contains(where, F.lower(F.trim(c))), w).otherwise(0.0)).otherwise(0.0)
    return hit(active, 0.35) + hit(location, 0.15)


# The chunk field that a requested field means.
FIELD_NAMES = (("docs", "required_documents"), ("fee", "fee"), ("time", "processing_time"), ("method", "submission_method"))


def field_bonus(fields: Column, chunk_field: Column) -> Column:
    """0.55 if the chunk is of the first requested field, 0.35 if of a later one."""
    key = F.coalesce(*[F.when(chunk_field == name, F.lit(k)) for k, name in FIELD_NAMES], chunk_field)
    at = F.coalesce(F.array_position(fields, key), F.lit(0))
    return F.when(at == 1, 0.55).when(at > 1, 0.35).otherwise(0.0)


def negation_penalty(query: Column, document_id: Column, aliases: Column, phrases: Sequence[tuple[str, str]] = ()) -> Column:
    """1.50 if the question holds a phrase that excludes the document, and 0.60 if it denies one of its aliases."""
    q = F.lower(F.coalesce(query, F.lit("")))
    excluded = reduce(lambda a, p: a | (F.contains(q, F.lit(p[0].lower())) & (document_id == p[1])), phrases, F.lit(False))
    denied = F.coalesce(F.exists(aliases, lambda a: is_negated(a, q)), F.lit(False))
    return F.when(excluded, 1.5).otherwise(0.0) + F.when(denied, 0.6).otherwise(0.0)


def hybrid(hits: DataFrame, k: int | None = None) -> DataFrame:
    """hits(query_id, chunk_id, vector_score, keyword, alias, context, penalty, field_score) with doc_base_score,
    retrieval_score and rank."""
    base = F.col("vector_score") + F.col("keyword") + F.col("alias") + F.col("context") - F.col("penalty")
    scored = hits.withColumn("doc_base_score", base).withColumn("retrieval_score", F.col("doc_base_score") + F.col("field_score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("retrieval_score", 9)), "chunk_id")))
    return ranked.filter(F.col("rank") <= k) if k else ranked


# --- gates -------------------------------------------------------------------


def entity_matches(queries: DataFrame, catalog: DataFrame | None = None, keywords: Sequence[str] = (), broad: Sequence[str] = lists.TOO_BROAD, always: Sequence[str] = lists.ALWAYS_ENTITIES) -> DataFrame:
    """queries(query_id, query) with entity: whether it names a keyword or an alias of at least four characters.

    Aliases are found through their first word, so questions and aliases meet in an equi-join, not as all pairs.
    """
    q = F.lower(expand_abbreviations(F.coalesce("query", F.lit(""))))
    qf = fold_vowels(q)
    words = [k for k in keywords if k]
    plain = reduce(lambda a, w: a | (~fold_vowels(F.lit(w.lower())).isin(*broad) & (F.contains(q, F.lit(w.lower())) | F.contains(qf, fold_vowels(F.lit(w))))), words, F.lit(False))
    named = reduce(lambda a, w: a | F.contains(qf, F.lit(w)), always, plain)
    out = queries.withColumn("entity", named)
    if catalog is None:
        return out
    said = queries.select("query_id", q.alias("q"), qf.alias("qf"), F.explode(F.array_distinct(F.concat(tokens(qf), tokens(q)))).alias("w"))
    keyed = catalog.filter(F.length("alias") >= 4).select(F.lower("alias").alias("a"), fold_vowels(F.col("alias")).alias("af"))
    keyed = keyed.withColumn("w", F.get(tokens(F.col("af")), F.lit(0)))
    hit = said.join(keyed, "w").filter(F.contains("q", F.col("a")) | F.contains("qf", F.col("af"))).select("query_id").distinct()
    return out.join(hit.withColumn("_hit", F.lit(True)), "query_id", "left").withColumn("entity", F.col("entity") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def scope(top: DataFrame, blocked: Sequence[str] = lists.BLOCKED_TOPICS, least: float = 0.44, generic: Sequence[str] = lists.GENERIC_WORDS, abbreviations: Sequence = lists.ABBREVIATIONS) -> DataFrame:
    """top(query_id, query, title, vector_score, entity), the best hit of each question, with in_scope and scope_reason."""
    q = F.lower(expand_abbreviations(F.coalesce("query", F.lit("")), abbreviations))
    qf = fold_vowels(q)
    own, theirs = distinctive_tokens(F.col("query"), generic, abbreviations), distinctive_tokens(F.col("title"), generic, abbreviations)
    shared = F.size(F.array_intersect(own, theirs))
    ratio = shared / F.greatest(F.size(own), F.lit(1))
    marriage = F.contains(qf, F.lit("ket hon")) | F.contains(qf, F.lit("hon nhan"))

    def is_blocked(t: str) -> Column:
        low, plain = F.lower(F.lit(t)), fold_vowels(F.lit(t))
        found = F.rlike(q, F.concat(F.lit(f"{LEFT}\\Q"), low, F.lit(f"\\E{RIGHT}"))) | F.rlike(qf, F.concat(F.lit(f"{LEFT}\\Q"), plain, F.lit(f"\\E{RIGHT}")))
        return found & ~(marriage & (plain == "xuat nhap canh"))

    topic = F.coalesce(*[F.when(is_blocked(t), F.lit(t)) for t in blocked], F.lit(None).cast("string"))
    score = F.coalesce("vector_score", F.lit(0.0))
    says = lambda ok, why: F.struct(F.lit(ok).alias("ok"), (F.lit(why) if isinstance(why, str) else why).alias("why"))
    verdict = (
        F.when(topic.isNotNull(), says(False, F.concat(F.lit("matched_oos_topic:"), topic)))
        .when((F.size(own) == 0) & ~F.col("entity"), says(False, "vague_no_distinctive_subject"))
        .when(F.col("entity"), says(True, "entity_aligned"))
        .when((shared >= 2) & (ratio >= 0.5) & (score >= least), says(True, "title_aligned"))
        .when((score > 0) & (score < least), says(False, "low_semantic_score"))
        .when((shared >= 1) & (ratio >= 0.5) & (score >= least), says(True, "title_partial_aligned"))
        .otherwise(says(False, "no_entity_or_title_alignment"))
    )
    return top.withColumn("_v", verdict).withColumns({"in_scope": F.col("_v.ok"), "scope_reason": F.col("_v.why")}).drop("_v")


def document_scores(hits: DataFrame, general_weight: float = 1.03, active: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, doc_score): the best base score of a document's chunks, general ones weighted; less 1.50 if
    the question excludes it, and 0.15 more if it is the active one."""
    base = F.col("doc_base_score") * F.when(F.col("field") == "general", general_weight).otherwise(1.0)
    out = hits.groupBy("query_id", "document_id").agg(F.max(base).alias("doc_score"))
    for other, worth in ((excluded, -1.5), (active, 0.15)):
        if other is not None:
            out = out.join(other.select("query_id", "document_id").distinct().withColumn("_w", F.lit(worth)), ["query_id", "document_id"], "left")
            out = out.withColumn("doc_score", F.col("doc_score") + F.coalesce("_w", F.lit(0.0))).drop("_w")
    return out


def ranked_documents(scores: DataFrame) -> DataFrame:
    return scores.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("doc_score", 9)), "document_id")))


def best_document(scores: DataFrame) -> DataFrame:
    return ranked_documents(scores).filter("doc_rank = 1").select("query_id", "document_id", "doc_score")


def ambiguous(hits: DataFrame, vague: DataFrame, gap: float = 0.08, active: DataFrame | None = None) -> DataFrame:
    """(query_id) of the questions to ask back: vague(query_id, vague), the two best documents closer than gap, none active."""
    per = hits.groupBy("query_id", "document_id").agg(F.max("retrieval_score").alias("s"))
    two = per.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "document_id"))).filter("n <= 2")
    close = two.groupBy("query_id").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("d")).filter((F.col("n") == 2) & (F.col("d") < gap))
    out = close.join(vague.filter("vague"), "query_id", "left_semi").select("query_id")
    return out.join(active.select("query_id"), "query_id", "left_anti") if active is not None else out


def select_chunks(hits: DataFrame, scores: DataFrame, fields: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks of each question: hits(query_id, chunk_id, document_id, field, retrieval_score), scores(query_id,
    document_id, doc_score), fields(query_id, fields array<string>).

    Every hit gets a bucket, and the buckets in order fill the k places. With two or more requested fields: a quota of each
    field's chunks of the best document, then its general chunks, then one chunk of each next document. With one field: the
    best document's chunks of it (else general ones, else all), its general ones, then one of each next document. Without:
    the best document's chunks, then all others.
    """
    f = F.coalesce("fields", F.array().cast("array<string>"))
    docs = ranked_documents(scores).select("query_id", "document_id", "doc_rank")
    rows = hits.join(docs, ["query_id", "document_id"]).join(fields, "query_id", "left").withColumn("_fields", f)
    key = F.coalesce(*[F.when(F.col("field") == name, F.lit(c)) for c, name in FIELD_NAMES], F.col("field"))
    at = F.coalesce(F.array_position("_fields", key), F.lit(0)).cast("int")
    own, n = F.col("doc_rank") == 1, F.size("_fields")
    rows = rows.withColumns({"_at": at, "_n": n, "_own": own, "_general": F.col("field") == "general"})
    per_query = Window.partitionBy("query_id")
    has = lambda c: F.max(c.cast("int")).over(per_query) == 1
    rows = rows.withColumns({"_any": has(F.col("_own") & (F.col("_at") > 0)), "_gen": has(F.col("_own") & F.col("_general"))})
    order = [F.desc(F.round("retrieval_score", 9)), "chunk_id"]
    in_field = F.row_number().over(Window.partitionBy("query_id", "document_id", "_at").orderBy(*order))
    # of another document one chunk: of the first requested field if there is one, else the best
    lead = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.when(F.col("_at") == 1, 0).otherwise(1), *order))
    quota = F.greatest(F.lit(1), F.floor((F.lit(k) - 1) / F.greatest("_n", F.lit(1)))).cast("int")
    rows = rows.withColumns({"_in": in_field, "_lead": lead, "_quota": quota})
    other = 1000 + F.col("doc_rank")
    target = F.when(F.col("_any"), F.col("_at") > 0).when(F.col("_gen"), F.col("_general")).otherwise(F.lit(True))
    bucket = (
        F.when(F.col("_n") == 0, F.when(F.col("_own"), 0).otherwise(other))
        .when(F.col("_own") & (F.col("_n") >= 2) & (F.col("_at") > 0) & (F.col("_in") <= F.col("_quota")), F.col("_at"))
        .when(F.col("_own") & (F.col("_n") >= 2) & F.col("_general"), 900)
        .when(F.col("_own") & (F.col("_n") == 1) & target, 1)
        .when(F.col("_own") & (F.col("_n") == 1) & F.col("_general"), 900)
        .when(~F.col("_own") & (F.col("_lead") == 1), other)
    )
    chosen = rows.withColumn("_bucket", bucket).filter("_bucket is not null")
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_bucket", *order))).filter(F.col("place") <= k)
    return chosen.select(*hits.columns, "place")


# --- reranking and evidence ---------------------------------------------------


def ngram_bonus(query: Column, content: Column, most: float = 0.35) -> Column:
    """0.04 for each two-word and 0.06 for each three-word run of the question that the content holds."""
    w = F.filter(tokens(query), lambda x: F.length(x) > 1)
    text = F.lower(F.coalesce(content, F.lit("")))

    runs = lambda n, worth: F.size(F.filter(runs_of(w, n), lambda x: F.contains(text, x))) * worth
    return F.when(F.size(w) < 2, 0.0).otherwise(F.least(runs(2, 0.04) + runs(3, 0.06), F.lit(most)))


def rerank(hits: DataFrame) -> DataFrame:
    """hits(query_id, query, content, retrieval_score, rank) with rerank_score and a new rank; ties keep the old order."""
    scored = hits.withColumn("rerank_score", F.col("retrieval_score") + ngram_bonus(F.col("query"), F.col("content")))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank"))).drop("rank").withColumnRenamed("new_rank", "rank")


def relevant(hits: DataFrame, least: float = 0.5, strict: bool = False) -> DataFrame:
    """Hits of at least the score; in strict mode nothing of a question whose best hit is below it."""
    kept = hits.filter(F.col("retrieval_score") >= least)
    if not strict:
        return kept
    top = hits.filter("rank = 1").filter(F.col("retrieval_score") >= least).select("query_id")
    return kept.join(top, "query_id", "left_semi")


def number_evidence(hits: DataFrame, start: int = 1) -> DataFrame:
    return hits.withColumn("candidate_id", F.format_string("EC_%03d", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + (start - 1)).cast("int")))


# --- mentions ----------------------------------------------------------------


def _plain(text: str) -> str:
    """Lower case without non-spacing marks and outer spaces; letters that only look marked, as đ, stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn").strip()


def named_in(text: str, names: Sequence[tuple[str, str]]) -> list[tuple[str, int]]:
    """(document, position) of names(alias, document) in a text, longest alias first, of equal ones the least document and
    alias. A match, in the lower-case text or else in the plain one, is blanked in both, so that shorter aliases can't use
    it; each document counts once."""
    low, plain, found = text.lower(), _plain(text), {}
    for alias, doc in sorted(names, key=lambda n: (-len(n[0]), n[1], n[0])):
        if doc in found:
            continue
        at = low.find(alias)
        at = plain.find(alias) if at < 0 else at
        if at >= 0:
            found[doc] = at
            low, plain = (t[:at] + " " * len(alias) + t[at + len(alias) :] for t in (low, plain))
    return list(found.items())


def _scan(folder: str, shards: int, at_once: int):
    system, base = fs.FileSystem.from_uri(folder)

    def automaton(shard: int) -> tuple:
        import ahocorasick

        finder, path = ahocorasick.Automaton(), f"{base}/shard={shard}"
        if system.get_file_info(path).type != fs.FileType.NotFound:
            held = pq.read_table(path, filesystem=system, columns=["alias", "document_id"], partitioning=None)
            for alias, doc in zip(held["alias"].to_pylist(), held["document_id"].to_pylist(), strict=True):
                for form in {alias.lower().strip(), _plain(alias)} - {""}:
                    finder.add_word(form, (form, [*finder.get(form, (form, []))[1], doc]))
        finder.make_automaton()
        return finder, len(finder)

    def settle(rows: list[tuple], only: tuple | None) -> pd.DataFrame:
        near: list[set] = [set() for _ in rows]
        for shard in range(shards):
            finder, n = only or automaton(shard)
            for i, (_, text) in enumerate(rows if n else []):
                for form in {text.lower(), _plain(text)}:
                    near[i].update((alias, doc) for _, (alias, docs) in finder.iter(form) for doc in docs)
        out = [(key, doc, no + 1, at) for (key, text), names in zip(rows, near, strict=True) for no, (doc, at) in enumerate(named_in(text, list(names)))]
        return pd.DataFrame(out, columns=["query_id", "document_id", "found_no", "position"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only, held, size = automaton(0) if shards == 1 else None, [], 0
        for pdf in batches:
            for key, text in zip(pdf["query_id"], pdf["text"], strict=True):
                held.append((key, text or ""))
                size += len(text or "")
                if size > at_once:  # with several shards, each is built anew for so many characters of text
                    yield settle(held, only)
                    held, size = [], 0
        if held:
            yield settle(held, only)

    return run


def mentions(texts: DataFrame, catalog: DataFrame, shard: int = 200_000, at_once: int = 32 << 20) -> DataFrame:
    """(query_id, document_id, found_no, position): the documents of catalog(document_id, alias) that texts(query_id, text) name,
    in the order in which they are found: longest alias first, anywhere in the text, also inside words, each document once.
    Outer spaces of names don't count, and blank names name nothing.

    The names are written to the shared folder in shards of about so many; a task builds an automaton of one shard at a time
    and scans its texts with each, so a catalog of any size goes through neither the driver nor one task's memory."""
    names = catalog.select("document_id", "alias").filter("document_id is not null and alias is not null").distinct()
    shards = max(1, -(-names.count() // shard))
    folder = scratch(texts.sparkSession, "names")
    names.withColumn("shard", F.pmod(F.xxhash64("alias"), F.lit(shards))).repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    kind = dict(texts.dtypes)["query_id"]
    return texts.select("query_id", "text").mapInPandas(_scan(folder, shards, at_once), f"query_id {kind}, document_id {dict(catalog.dtypes)['document_id']}, found_no int, position int")


def sub_queries(found: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, sub_no, document_id, fields, truncated): one row for each mentioned document, in the order found, at most
    `most`; a question without mentions is one sub-question of its own. queries has query_id, fields."""
    counted = found.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("found_no") <= most)
    out = queries.select("query_id", "fields").join(counted, "query_id", "left")
    return out.select("query_id", F.coalesce("found_no", F.lit(1)).alias("sub_no"), "document_id", "fields", (F.coalesce("_n", F.lit(0)) > most).alias("truncated"))


def resolve_sub_queries(subs: DataFrame, hits: DataFrame, vague: Column | None = None, least: float = 0.5, gap: float = 0.08, general_weight: float = 1.2) -> DataFrame:
    """subs(query_id, sub_no, mention, hint) with document_id, title, score and status FOUND, AMBIGUOUS or NOT_FOUND; hits(query_id,
    sub_no, document_id, title, field, retrieval_score, rank) are of a search for the mention.

    The document is that of the first hit whose title holds the hint, or the other way round, with that hit's score; else
    the one with the best score, general chunks weighted, the first of equals. If the mention is vague (an expression on
    subs; by default is_vague()) and the first hits of the two first documents are closer than gap, it is AMBIGUOUS, named or
    not; else FOUND if the score is at least `least`."""
    by = ["query_id", "sub_no"]
    asked = subs.withColumn("_vague", is_vague(F.col("mention")) if vague is None else vague)
    low, hint = F.lower(F.coalesce("title", F.lit(""))), F.lower("hint")
    named = F.coalesce((F.col("hint") != "") & (F.contains(low, hint) | F.contains(hint, low)), F.lit(False))
    rows = hits.join(asked.select(*by, "hint"), by).withColumns({"_named": named, "_weighted": F.col("retrieval_score") * F.when(F.col("field") == "general", general_weight).otherwise(1.0)})
    documents = rows.groupBy(*by, "document_id").agg(
        F.min("rank").alias("_first"), F.min_by("retrieval_score", "rank").alias("_own"), F.min_by("title", "rank").alias("_title"), F.max("_weighted").alias("_best"),
        F.min(F.when(F.col("_named"), F.struct("rank", "retrieval_score", "title"))).alias("_hit"),
    )
    one = documents.groupBy(*by).agg(
        F.min(F.when(F.col("_hit").isNotNull(), F.struct(F.col("_hit.rank").alias("rank"), "document_id", F.col("_hit.retrieval_score").alias("score"), F.col("_hit.title").alias("title")))).alias("_named"),
        F.max(F.struct(F.col("_best").alias("score"), (-F.col("_first")).alias("first"), "document_id", F.col("_title").alias("title"))).alias("_top"),
        F.slice(F.sort_array(F.collect_list(F.struct("_first", "_own"))), 1, 2).alias("_two"),
    )
    out = asked.join(one, by, "left")
    score = F.coalesce("_named.score", "_top.score", F.lit(0.0))
    close = F.col("_vague") & (F.size("_two") == 2) & (F.get("_two", F.lit(0))["_own"] - F.get("_two", F.lit(1))["_own"] < gap)
    status = F.when(F.coalesce(close, F.lit(False)), "AMBIGUOUS").when(F.col("_top").isNotNull() & (score >= least), "FOUND").otherwise("NOT_FOUND")
    out = out.withColumns({"status": status, "score": score})
    found = F.when(F.col("status") == "FOUND", F.coalesce("_named.document_id", "_top.document_id"))
    title = F.when(F.col("status") != "AMBIGUOUS", F.when(F.col("_named").isNotNull(), F.col("_named.title")).otherwise(F.col("_top.title")))
    return out.withColumns({"document_id": found, "title": title}).drop("_vague", "_named", "_top", "_two")


def resolved_chunks(resolved: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, sub_no, chunk_id, place): the k chunks of each sub-question that is FOUND, from its document's hits. With two
    or more requested fields: a quota of each field's chunks by score, then general ones, then the rest; with one: the
    field's chunks by rank (else general ones, else all), then general ones; without: the best by score."""
    by = ["query_id", "sub_no"]
    asked = resolved.filter("status = 'FOUND'").select(*by, "document_id", F.coalesce("fields", F.array().cast("array<string>")).alias("_fields"))
    rows = hits.join(asked, [*by, "document_id"])
    key = F.coalesce(*[F.when(F.col("field") == name, F.lit(c)) for c, name in FIELD_NAMES], F.col("field"))
    at = lambda c: F.nullif(F.array_position("_fields", c), F.lit(0))
    rows = rows.withColumns({"_at": F.coalesce(F.least(at(key), at(F.col("field"))), F.lit(0)).cast("int"), "_n": F.size("_fields"), "_general": F.col("field") == "general"})
    whole = Window.partitionBy(*by)
    has = lambda c: F.max(c.cast("int")).over(whole) == 1
    score = F.desc(F.round("retrieval_score", 9))
    rows = rows.withColumns({"_any": has(F.col("_at") > 0), "_gen": has(F.col("_general")), "_in": F.row_number().over(Window.partitionBy(*by, "_at").orderBy(score, "rank"))})
    quota = F.greatest(F.lit(1), F.floor(F.lit(k - 1) / F.greatest("_n", F.lit(1))))
    target = F.when(F.col("_any"), F.col("_at") > 0).when(F.col("_gen"), F.col("_general")).otherwise(F.lit(True))
    bucket = (
        F.when(F.col("_n") == 0, 0)
        .when((F.col("_n") >= 2) & (F.col("_at") > 0) & (F.col("_in") <= quota), F.col("_at"))
        .when((F.col("_n") == 1) & target, 0)
        .when(F.col("_general"), 900)
        .when(F.col("_n") >= 2, 1000)
    )
    inside = F.when(F.col("_n") == 1, F.col("rank").cast("double")).otherwise(-F.round("retrieval_score", 9))
    inside = F.when((F.col("_n") >= 2) & (F.col("_b") == 900), F.col("rank").cast("double")).otherwise(inside)
    chosen = rows.withColumn("_b", bucket).filter("_b is not null")
    chosen = chosen.withColumn("place", F.row_number().over(whole.orderBy("_b", inside, "rank"))).filter(F.col("place") <= k)
    return chosen.select(*by, "chunk_id", "place")


def answer_plan(resolved: DataFrame) -> DataFrame:
    """One row for each question: the titles found and, of the other sub-questions, the suggested titles or mentions, both in
    order, the number of sub-questions, and whether some were cut."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"])
    named = F.struct("sub_no", F.coalesce(F.nullif("title", F.lit("")), "mention").alias("v"))
    return resolved.groupBy("query_id").agg(
        ordered(F.when(F.col("status") == "FOUND", named)).alias("found"), ordered(F.when(F.col("status") != "FOUND", named)).alias("missing"), F.count("*").alias("n_sub"), F.bool_or("truncated").alias("truncated")
    )
