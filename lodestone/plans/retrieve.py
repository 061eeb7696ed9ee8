"""Queries that index the documents and search, rank, select and verify for the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dedup, evaluate, ranking, search, verify
from lodestone.plans.ingest import TITLE_SQL, titled
from lodestone.plans.texts import FROM, STOP, TO, distinctive_sql, meaningful_sql, subject_sql
from lodestone.runtime import materialize, spread, table


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document: (chunk_id, document_id, title, category, text)."""
    d = titled(spark, sf_dir)
    return d.select(F.col("row_index").alias("chunk_id"), "document_id", "title", F.col("lang").alias("category"), F.col("content").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def postings_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_totals(chunks_of(spark, sf_dir)).select("term", "df", F.round("tf", 1).alias("tf"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(chunks_of(spark, sf_dir), questions(spark, sf_dir), 15)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _hits(spark: SparkSession, sf_dir: str, k: int = 15) -> DataFrame:
    chunks, asked = chunks_of(spark, sf_dir), questions(spark, sf_dir)
    found = materialize(search.search(chunks, asked, k), "hits")
    return _picked(found, chunks.join(search.few(found.select("chunk_id").distinct()), "chunk_id", "left_semi")).join(asked, "query_id")


def _picked(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks, whose texts are read once and written, so that what is done to them later is
    spread over all tasks."""
    return found.join(materialize(texts, "hit-texts"), "chunk_id")


def _expected(spark: SparkSession, sf_dir: str, index: search.Index) -> DataFrame:
    asked = questions(spark, sf_dir)
    held = search.containing(asked, chunks_of(spark, sf_dir), index).groupBy("query_id").agg(F.collect_list(F.col("chunk_id")).alias("expected_docs"))
    return asked.join(held, "query_id", "left").select(F.col("query_id").alias("case_id"), F.coalesce("expected_docs", F.array().cast("array<bigint>")).alias("expected_docs"))


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each question with the rank of an expected document, and one (case_id null) with the metrics of all."""
    chunks, asked = chunks_of(spark, sf_dir), questions(spark, sf_dir)
    index = search.build_index(chunks, queries=asked)
    hits = search.search_index(index, asked, chunks, 5).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("document_id"), "rank")
    ranked = evaluate.expected_ranks(_expected(spark, sf_dir, index), hits)
    ranked = materialize(ranked.select("case_id", F.size("expected_docs").cast("long").alias("n_expected"), F.col("rank").cast("long").alias("rank")), "ranked")
    total = evaluate.rank_metrics(ranked.filter("n_expected > 0"))
    each = ranked.withColumns({c: F.lit(None).cast("double") for c in ("retrieval_at_1", "retrieval_at_3", "retrieval_at_5", "mrr")})
    summary = total.select(F.lit(None).cast("bigint").alias("case_id"), F.col("n").alias("n_expected"), F.lit(None).cast("bigint").alias("rank"), *[F.round(c, 6).alias(c) for c in ("retrieval_at_1", "retrieval_at_3", "retrieval_at_5", "mrr")])
    return each.unionByName(summary)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_no"), "embedding")
    asked = e.filter(F.col("chunk_no") % 50 == 0).withColumnRenamed("chunk_no", "query_id")
    top = search.vector_top_k(e, asked, 10)
    return top.select("query_id", "chunk_no", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    none = F.array().cast("array<string>")
    aliases = F.array(F.lower("title"))
    h = h.withColumns(
        {
            "vector_score": F.col("score"), "keyword": ranking.keyword_bonus(F.col("query"), F.col("title"), F.col("text"), STOP, ()), "alias": ranking.alias_bonus(F.col("query"), aliases, STOP, ()),
            "context": ranking.context_bonus(F.substring_index("query", " ", 2), F.lit("the"), F.col("title"), F.col("text")), "penalty": ranking.negation_penalty(F.col("query"), F.col("document_id"), none, (("the", "7"),)),
            "field_score": ranking.field_bonus(F.array(F.lit("fr"), F.lit("en")), F.col("category")),
        }
    ).drop("rank", "score", "raw_score")
    ranked = ranking.hybrid(h)
    again = ranking.rerank(ranked.withColumnRenamed("text", "content"))
    return again.select("query_id", "chunk_id", F.round("keyword", 4).alias("keyword"), "alias", "context", "field_score", F.round("retrieval_score", 4).alias("retrieval_score"), F.round("rerank_score", 4).alias("rerank_score"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with documents of several chunks: the document is the source, the field the language."""
    h = _hits(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    source = source.join(search.few(h.select("chunk_id").distinct()), "chunk_id", "left_semi")
    field = F.when(F.col("category") == "en", "general").when(F.col("category") == "fr", "fee").when(F.col("category") == "de", "processing_time").otherwise("required_documents")
    return h.join(source, "chunk_id").select("query_id", "query", "chunk_id", F.col("source").alias("document_id"), "title", F.col("text").alias("content"), field.alias("field"), F.col("score").alias("doc_base_score"), F.col("score").alias("retrieval_score"), "rank")


def document_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = materialize(_scored(spark, sf_dir), "scored")
    active = h.filter("rank = 2").select("query_id", "document_id")
    best = ranking.best_document(ranking.document_scores(h, active=active))
    first = dedup.first_per_document(h).groupBy("query_id").agg(F.count("*").alias("n_documents"))
    unsure = ranking.ambiguous(h, h.select("query_id", F.lit(True).alias("vague")).distinct()).withColumn("ambiguous", F.lit(True))
    out = best.join(first, "query_id").join(unsure, "query_id", "left")
    return out.select("query_id", "document_id", F.round("doc_score", 4).alias("doc_score"), "n_documents", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def chunk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = materialize(_scored(spark, sf_dir), "scored")
    asked = F.when(F.col("query_id") % 3 == 0, F.array()).when(F.col("query_id") % 3 == 1, F.array(F.lit("fee"))).otherwise(F.array(F.lit("time"), F.lit("docs"))).cast("array<string>")
    fields = h.select("query_id").distinct().withColumn("fields", asked)
    chosen = ranking.select_chunks(h, ranking.document_scores(h), fields)
    return chosen.select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "document_id", "field")


def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir, 1).filter("rank = 1")
    top = ranking.entity_matches(h.select("query_id", "query"), None, ("whsh", "ingan"), (), ()).join(h.select("query_id", "title", F.col("score").alias("vector_score")), "query_id")
    out = ranking.scope(top, ("blees", "ndndnd"), 0.9, STOP, ())
    return out.select("query_id", "entity", "in_scope", "scope_reason")


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ranking.relevant(_hits(spark, sf_dir, 5).withColumn("retrieval_score", F.col("score")), 0.9, strict=True)
    return ranking.number_evidence(h).select("query_id", "candidate_id", "chunk_id")


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = _hits(spark, sf_dir, 3)
    evidence = materialize(ranking.number_evidence(h).select("query_id", "candidate_id", "document_id", "title", F.col("text").alias("content"), F.col("category").alias("field"), "rank"), "evidence")
    answers = questions(spark, sf_dir).select("query_id", F.col("query").alias("answer"))
    return answers, evidence


def claim_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, evidence = _evidence(spark, sf_dir)
    c = verify.explode_claims(answers).join(evidence, "query_id")
    w = lambda x: verify.meaningful_tokens(F.col(x), STOP)
    return c.select(
        "query_id", F.col("claim_no").cast("long").alias("claim_no"), "candidate_id", F.round(verify.overlap(w("claim"), w("content")), 4).alias("overlap"),
        F.round(verify.pair_overlap(w("claim"), w("content")), 4).alias("pair_overlap"), verify.number_conflict(verify.numbers(F.col("claim")), verify.numbers(F.col("content"))).alias("number_conflict"),
    )


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, evidence = _evidence(spark, sf_dir)
    v = verify.verify(answers, evidence, STOP)
    cites = verify.map_citations(v, evidence).select("query_id", "claim_no", F.size("citations").cast("long").alias("n_citations"))
    out = v.join(cites, ["query_id", "claim_no"], "left")
    return out.select("query_id", F.col("claim_no").cast("long").alias("claim_no"), "header", "status", "conflict", F.round("score", 4).alias("score"), F.array_join("evidence_ids", ",").alias("evidence_ids"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


def filtered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, evidence = _evidence(spark, sf_dir)
    kept = verify.filter_answers(verify.verify(answers, evidence, STOP))
    plain = verify.evidence_answers(evidence).select("query_id", F.md5("answer").alias("evidence_answer_md5"))
    fields = answers.select("query_id", F.array(F.lit("en")).alias("fields"))
    template = verify.template_answers(evidence, fields).select("query_id", F.md5("answer").alias("template_md5"))
    return kept.join(plain, "query_id", "left").join(template, "query_id", "left").select("query_id", F.md5("answer").alias("answer_md5"), F.col("n_kept").cast("long").alias("n_kept"), "critical", "evidence_answer_md5", "template_md5")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The openings of the benchmark passages as titles."""
    return questions(spark, sf_dir).select(F.concat(F.lit("PROC_"), F.col("query_id").cast("string")).alias("document_id"), F.substring_index("query", " ", 3).alias("alias"))


def mention_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark openings as titles, looked for in the documents: the sub-questions of each text."""
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("query_id"), "text")
    subs = ranking.sub_queries(ranking.mentions(texts, _names(spark, sf_dir)), texts.select("query_id", F.array(F.lit("fee")).alias("fields")))
    return subs.select("query_id", F.col("sub_no").cast("long").alias("sub_no"), "document_id", "truncated")


def answer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as questions: what they name is searched in the documents and resolved to one of them."""
    asked, names = questions(spark, sf_dir), _names(spark, sf_dir)
    found = ranking.mentions(asked.withColumnRenamed("query", "text"), names)
    subs = ranking.sub_queries(found, asked.select("query_id", F.array(F.lit("fee"), F.lit("docs")).alias("fields")))
    subs = subs.join(names, "document_id", "left").join(asked, "query_id")
    mention = F.coalesce("alias", "query")
    subs = materialize(subs.select("query_id", "sub_no", mention.alias("mention"), F.col("alias").alias("hint"), "fields", "truncated", F.xxhash64(mention).alias("search_id")), "sub-questions")
    chunks = chunks_of(spark, sf_dir)
    hits = search.search(chunks, subs.select(F.col("search_id").alias("query_id"), F.col("mention").alias("query")).distinct(), 15).withColumnRenamed("query_id", "search_id")
    field = F.when(F.col("category") == "en", "general").when(F.col("category") == "fr", "fee").otherwise("required_documents")
    hits = materialize(hits, "hits")
    named = chunks.join(search.few(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    hits = _picked(hits, named.select("chunk_id", "document_id", "title", field.alias("field"))).join(subs.select("query_id", "sub_no", "search_id"), "search_id")
    hits = materialize(hits.select("query_id", "sub_no", "chunk_id", "document_id", "title", "field", F.col("score").alias("retrieval_score"), "rank"), "sub-hits")
    done = materialize(ranking.resolve_sub_queries(subs, hits).drop("search_id"), "resolved")
    n_chunks = ranking.resolved_chunks(done, hits).groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    plan = ranking.answer_plan(done).join(n_chunks, "query_id", "left")
    return plan.select("query_id", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"), "n_sub", "truncated", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


_W = {"t": 3.5, "c": 1.5, "x": 1.0}
_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_BOTH = lambda c: f"list_concat({_TOK.format(c)}, regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}_]+'))"
_CHUNKS = f"(SELECT doc_id AS chunk_id, {TITLE_SQL} AS t, lang AS c, text AS x, source FROM documents)"
_POST = "postings AS (SELECT chunk_id, term, sum(w) AS tf FROM (" + " UNION ALL ".join(f"SELECT chunk_id, unnest({_BOTH(f)}) AS term, {w} AS w FROM ch" for f, w in _W.items()) + ") GROUP BY chunk_id, term)"
_SEARCH = f"""WITH ch AS {_CHUNKS}, {_POST},
  st AS (SELECT term, count(*) AS df FROM postings GROUP BY term), ln AS (SELECT chunk_id, sum(tf) AS dl FROM postings GROUP BY chunk_id),
  co AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT sum(dl) FROM ln) / (SELECT count(*) FROM ch) AS av),
  q AS (SELECT item_id AS query_id, text AS query, lower(trim(text)) AS ql, strip_accents(lower(trim(text))) AS qf FROM benchmark),
  qt AS (SELECT query_id, unnest(list_distinct({_BOTH('trim(query)')})) AS term FROM q),
  bm AS (SELECT query_id, chunk_id, sum(CASE WHEN ln(1.0 + (n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.05 ELSE ln(1.0 + (n - df + 0.5) / (df + 0.5)) END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(av, 1.0)))) AS s
    FROM qt JOIN postings USING (term) JOIN st USING (term) JOIN ln USING (chunk_id), co GROUP BY query_id, chunk_id),
  fc AS (SELECT chunk_id, strip_accents(lower(t)) AS tf, strip_accents(lower(x)) AS xf FROM ch),
  bo AS (SELECT query_id, chunk_id, CASE WHEN contains(tf, qf) THEN 3.0 ELSE 0 END + CASE WHEN contains(xf, qf) THEN 1.2 ELSE 0 END AS bonus FROM q JOIN fc ON qf <> '' AND (contains(tf, qf) OR contains(xf, qf))),
  ph AS (SELECT query_id, chunk_id, coalesce(s, 0) + coalesce(bonus, 0) AS s FROM bm FULL JOIN bo USING (query_id, chunk_id)),
  hits AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(s / (s + 4.0), 4) AS score FROM ph WHERE s > 0))"""
_SCORED = """sc AS (SELECT query_id, chunk_id, source AS document_id, CASE c WHEN 'en' THEN 'general' WHEN 'fr' THEN 'fee' WHEN 'de' THEN 'processing_time' ELSE 'required_documents' END AS field, score, rank
  FROM hits JOIN ch USING (chunk_id) WHERE rank <= 15)"""
_EV = "ev AS (SELECT query_id, printf('EC_%03d', rank) AS candidate_id, x AS content FROM hits JOIN ch USING (chunk_id) WHERE rank <= 3)"
_CL = """cl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS claim_no, x AS claim FROM (SELECT query_id, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS x, generate_subscripts(p, 1) AS i FROM
  (SELECT query_id, string_split_regex(regexp_replace(query, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS p FROM q)) WHERE x <> '')"""


def _runs(n: int) -> str:
    parts = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"len(list_filter(list_transform(range(1, len(w) - {n - 2}), lambda i: {parts}), lambda g: contains(lower(x), g)))"


QUERIES = {
    "postings_statistics": postings_statistics, "bm25_search": bm25_search, "search_metrics": search_metrics, "vector_search": vector_search, "hybrid_ranking": hybrid_ranking, "document_choice": document_choice,
    "chunk_selection": chunk_selection, "scope_gate": scope_gate, "evidence_rows": evidence_rows, "claim_overlaps": claim_overlaps, "claim_verdicts": claim_verdicts, "filtered_answers": filtered_answers, "mention_plans": mention_plans, "answer_plans": answer_plans,
}

ORACLES = {
    "postings_statistics": f"WITH ch AS {_CHUNKS}, {_POST} SELECT term, count(*) AS df, round(sum(tf), 1) AS tf FROM postings GROUP BY term",
    "bm25_search": f"{_SEARCH} SELECT query_id, chunk_id, score, rank FROM hits WHERE rank <= 15",
    "search_metrics": f"""{_SEARCH}, e AS (SELECT query_id, chunk_id FROM q JOIN ch ON contains(x, query)), r AS (SELECT query_id, min(rank) AS rank FROM e JOIN hits USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY query_id),
        a AS (SELECT query_id AS case_id, (SELECT count(*) FROM e WHERE e.query_id = q.query_id) AS n_expected, rank FROM q LEFT JOIN r USING (query_id))
        SELECT case_id, n_expected, rank, CAST(NULL AS DOUBLE) AS retrieval_at_1, CAST(NULL AS DOUBLE) AS retrieval_at_3, CAST(NULL AS DOUBLE) AS retrieval_at_5, CAST(NULL AS DOUBLE) AS mrr FROM a
        UNION ALL SELECT NULL, count(*), NULL, round(avg(CASE WHEN rank <= 1 THEN 100.0 ELSE 0 END), 6), round(avg(CASE WHEN rank <= 3 THEN 100.0 ELSE 0 END), 6), round(avg(CASE WHEN rank <= 5 THEN 100.0 ELSE 0 END), 6),
        round(avg(coalesce(1.0 / rank, 0)), 6) FROM a WHERE n_expected > 0""",
    "vector_search": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_no, list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b WHERE a.vec_id % 50 = 0)
        SELECT query_id, chunk_no, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_no) AS rank FROM s) WHERE rank <= 10""",
    "hybrid_ranking": f"""{_SEARCH}, b AS (SELECT h.*, q.query, ql, t, x, c, {subject_sql('query')} AS qw, {subject_sql('t')} AS tw, {subject_sql('x')} AS xw, translate(ql, '{FROM}', '{TO}') AS qv,
          lower(array_to_string(string_split(query, ' ')[1:2], ' ')) AS act, list_filter({_TOK.format('query')}, lambda y: length(y) > 1) AS w FROM hits h JOIN q USING (query_id) JOIN ch USING (chunk_id) WHERE rank <= 15),
        k AS (SELECT *, len(list_intersect(qw, tw)) * 0.30 + len(list_intersect(qw, xw)) * 0.03 AS keyword, translate(lower(t), '{FROM}', '{TO}') AS tf FROM b),
        a AS (SELECT *, CASE WHEN lower(t) = '' THEN 0.0 WHEN contains(ql, lower(t)) OR (length(tf) >= 4 AND contains(qv, tf)) THEN 0.85 WHEN len(tw) > 0 AND len(list_intersect(tw, qw)) = len(tw) THEN 0.55 WHEN len(list_intersect(tw, qw)) >= 2 THEN 0.25 ELSE 0.0 END AS alias,
          CASE WHEN act <> '' AND contains(lower(t || ' ' || x), trim(act)) THEN 0.35 ELSE 0.0 END + CASE WHEN contains(lower(t || ' ' || x), 'the') THEN 0.15 ELSE 0.0 END AS context,
          CASE WHEN contains(lower(query), 'the') AND chunk_id = 7 THEN 1.5 ELSE 0.0 END AS penalty, CASE c WHEN 'fr' THEN 0.55 WHEN 'en' THEN 0.35 ELSE 0.0 END AS field_score FROM k),
        f AS (SELECT *, score + keyword + alias + context - penalty + field_score AS total, CASE WHEN len(w) < 2 THEN 0 ELSE least({_runs(2)} * 0.04 + {_runs(3)} * 0.06, 0.35) END AS bonus FROM a)
        SELECT query_id, chunk_id, round(keyword, 4) AS keyword, alias, context, field_score, round(total, 4) AS retrieval_score, round(total + bonus, 4) AS rerank_score FROM f""",
    "document_choice": f"""{_SEARCH}, {_SCORED}, act AS (SELECT query_id, document_id FROM sc WHERE rank = 2),
        d AS (SELECT query_id, document_id, max(score * CASE WHEN field = 'general' THEN 1.03 ELSE 1.0 END) + CASE WHEN (query_id, document_id) IN (SELECT (query_id, document_id) FROM act) THEN 0.15 ELSE 0 END AS s, max(score) AS m FROM sc GROUP BY query_id, document_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, document_id) AS n, count(*) OVER (PARTITION BY query_id) AS nd,
          nth_value(m, 1) OVER w - nth_value(m, 2) OVER w AS gap FROM d WINDOW w AS (PARTITION BY query_id ORDER BY m DESC, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT query_id, document_id, round(s, 4) AS doc_score, nd AS n_documents, coalesce(gap < 0.08, false) AS ambiguous FROM r WHERE n = 1""",
    "scope_gate": f"""{_SEARCH}, b AS (SELECT query_id, ql, translate(ql, '{FROM}', '{TO}') AS qv, {distinctive_sql('query')} AS own, {distinctive_sql('t')} AS their, score FROM hits JOIN q USING (query_id) JOIN ch USING (chunk_id) WHERE rank = 1),
        e AS (SELECT *, contains(ql, 'whsh') OR contains(ql, 'ingan') OR contains(qv, 'whsh') OR contains(qv, 'ingan') AS entity, len(list_intersect(own, their)) AS o, len(list_intersect(own, their)) / greatest(len(own), 1) AS r,
          regexp_extract_all(ql, '[\\p{{L}}\\p{{N}}_]+') AS w FROM b),
        v AS (SELECT query_id, entity, CASE WHEN list_contains(w, 'blees') THEN 'matched_oos_topic:blees' WHEN list_contains(w, 'ndndnd') THEN 'matched_oos_topic:ndndnd' WHEN len(own) = 0 AND NOT entity THEN 'vague_no_distinctive_subject'
          WHEN entity THEN 'entity_aligned' WHEN o >= 2 AND r >= 0.5 AND score >= 0.9 THEN 'title_aligned' WHEN score > 0 AND score < 0.9 THEN 'low_semantic_score' WHEN o >= 1 AND r >= 0.5 AND score >= 0.9 THEN 'title_partial_aligned'
          ELSE 'no_entity_or_title_alignment' END AS scope_reason FROM e)
        SELECT query_id, entity, scope_reason IN ('entity_aligned', 'title_aligned', 'title_partial_aligned') AS in_scope, scope_reason FROM v""",
    "evidence_rows": f"""{_SEARCH}, k AS (SELECT * FROM hits WHERE rank <= 5 AND score >= 0.9) SELECT query_id, printf('EC_%03d', row_number() OVER (PARTITION BY query_id ORDER BY rank)) AS candidate_id, chunk_id FROM k""",
    "claim_overlaps": f"""{_SEARCH}, {_EV}, {_CL}, m AS (SELECT query_id, claim_no, candidate_id, {meaningful_sql('claim')} AS a, {meaningful_sql('content')} AS b FROM cl JOIN ev USING (query_id)),
        p AS (SELECT *, list_distinct(a) AS da, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS pa FROM m),
        u AS (SELECT query_id, candidate_id, list(DISTINCT b[i] || ' ' || b[i + 1]) AS pb FROM (SELECT DISTINCT query_id, candidate_id, b, unnest(range(1, len(b))) AS i FROM m) GROUP BY query_id, candidate_id)
        SELECT query_id, claim_no, candidate_id, CASE WHEN len(da) > 0 THEN round(len(list_intersect(da, b)) / len(da), 4) ELSE 0.0 END AS overlap,
        CASE WHEN len(a) < 2 OR len(b) < 2 THEN 0.0 ELSE round(len(list_intersect(pa, pb)) / len(pa), 4) END AS pair_overlap, false AS number_conflict FROM p JOIN u USING (query_id, candidate_id)""",
}
