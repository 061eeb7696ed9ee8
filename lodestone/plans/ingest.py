"""Queries that prepare documents: records, validation, chunks, exact and near duplicates, index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, dedup, normalize
from lodestone.runtime import scratch, spread, table
from lodestone.sources import index_store, ingest_job, readers

TITLE_SQL = "regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g')"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (row_index, document_id, title, content, lang, source); the title is the first line."""
    return _titled(spread(table(spark, sf_dir, "documents")))


def _titled(docs: DataFrame) -> DataFrame:
    title = F.regexp_replace(F.substring_index("text", "\n", 1), r"^\s+|\s+$", "")
    return docs.select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("document_id"), title.alias("title"), F.col("text").alias("content"), "lang", "source")


def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["p_name", "p_brand", "p_type", "p_size"]
    return table(spark, sf_dir, "part").select("p_partkey", normalize.record_text(cols).alias("record"))


def resolve_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    m = normalize.ColumnMapping("c_custkey", "c_name", "c_mktsegment", None)
    doc_id = normalize.resolve_id([F.col(m.document_id)], F.lit(0))
    title = normalize.resolve_title([F.col(m.title)], [F.col("c_mktsegment")], None, F.lit(0))
    content = normalize.enrich_content(F.lit(""), F.lit(" "), title, ["c_name", "c_mktsegment"])
    aliases = normalize.parse_aliases(F.concat_ws(";", "c_name", "c_mktsegment"))
    return t.select(doc_id.alias("document_id"), title.alias("title"), normalize.resolve_category([F.col(m.category)]).alias("category"), F.array_join(aliases, "|").alias("aliases"), content.alias("content"))


def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.number_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], "lang")


def _rules() -> list[normalize.Rule]:
    return [*normalize.required("title", "content"), normalize.Rule("content", "min_length", F.length("content") >= 200), normalize.Rule("title", "max_length", F.length("title") <= 150)]


def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = normalize.validate(titled(spark, sf_dir), _rules())
    return bad.select("row_index", "document_id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["rule"])), ",").alias("errors"))


def ingest_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = titled(spark, sf_dir).withColumnRenamed("lang", "domain")
    valid, errors = normalize.validate(docs, _rules())
    kept, removed = dedup.exact(valid)
    gone = removed.select("row_index").join(docs.select("row_index", "domain"), "row_index")
    return normalize.accounting({"loaded": docs, "valid": valid, "errors": errors, "kept": kept, "removed": gone})


def data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = normalize.profile(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return p.select(F.array_join("columns", ",").alias("columns"), F.array_join(F.transform("sample", lambda r: r["text"]), "||").alias("sample"), "n_rows")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.drop_blank(chunking.document_chunks(titled(spark, sf_dir).select("document_id", "title", "content")))
    return chunks.select("chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.col("p_name").alias("title"), "p_brand", "p_type", F.split("p_name", " ").alias("aliases"))
    return chunking.record_chunks(t, ["p_brand", "p_type"]).select("chunk_id", "text")


def field_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("document_id"), F.col("p_name").alias("title"), F.col("p_type").alias("required_documents"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("fee"),
        F.col("p_brand").alias("notes"), F.concat_ws(" ", "p_name", "p_type").alias("content"),
    )
    specs = [chunking.FieldSpec("required_documents", "_docs", "Docs", merge_with=("notes",)), chunking.FieldSpec("fee", "_fee", "Fee")]
    out = chunking.route(t, specs)
    return out.select("chunk_id", "field", chunking.infer_field(F.lit(None).cast("string"), F.col("chunk_id")).alias("inferred"), "text")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(titled(spark, sf_dir))[1]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings and, as rows 1000000 on, a nearby copy of every fifth."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    near = F.transform("embedding", lambda x, i: (x * (1.0 + 0.2 * (i % 3 - 1))).cast("float"))
    return e.unionByName(e.filter(F.col("row_index") % 5 == 0).select((F.col("row_index") + 1_000_000).alias("row_index"), near.alias("embedding")))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_vectors(spark, sf_dir)).select("i", "j", F.round("sim", 4).alias("sim"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.pmod("row_index", F.lit(7)) + 1).cast("int")
    return dedup.near(_vectors(spark, sf_dir).withColumns({"document_id": F.col("row_index").cast("string"), "content": F.repeat(F.lit("x"), size)}))[1]


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = titled(spark, sf_dir)
    return docs.select("document_id", index_store.point_id(F.concat("document_id", F.lit("_doc_1"))).alias("point_id"), F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))


def upsert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents have chunks 1 and 2 in the index; the new rows hold another text for chunk 2 and a chunk 3."""
    docs = titled(spark, sf_dir)
    chunk = lambda n, text: docs.select(F.concat("document_id", F.lit(f"_doc_{n}")).alias("chunk_id"), text.alias("text"))
    old = chunk(1, F.col("content")).unionByName(chunk(2, F.col("title"))).withColumn("point_id", index_store.point_id(F.col("chunk_id")))
    new = chunk(2, F.concat(F.lit("new "), "title")).unionByName(chunk(3, F.concat("content", F.lit(" new"))))
    return index_store.upsert(old, new).select("point_id", "chunk_id", F.md5("text").alias("text_md5"))


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the documents were ingested, the batch replayed, and a batch without changes run."""
    store = index_store.IndexStore(spark, scratch(spark, "index"))
    for batch in (0, 0, 1):
        ingest_job.ingest(store, "documents", [{"type": "parquet", "path": f"{sf_dir}/documents.parquet"}], batch, rules=_rules(), documents=lambda raw: _titled(spread(raw)))
    return store.index().select("chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", readers.html_text_native(F.col("html")).alias("text"))


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = titled(spark, sf_dir).select(F.col("lang").alias("domain"), F.col("document_id").alias("path"), F.sha2("content", 256).alias("hash"), "row_index")
    registry = docs.filter(F.col("row_index") % 3 != 0).withColumn("hash", F.when(F.col("row_index") % 5 == 0, "stale").otherwise(F.col("hash"))).drop("row_index")
    return readers.changed_sources(docs.drop("row_index"), registry)


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id") % 4
    raw = b.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(k == 0, "CLARIFY/NONE").when(k == 1, "PROC_1, PROC_2").when(k == 2, "PROC_3").otherwise("none").alias("expected_document_id"),
        F.when(F.col("item_id") % 8 == 1, "REJECT").alias("expected_behavior"), F.when(F.col("item_id") % 2 == 0, "held_out").alias("split"),
    )
    out = readers.load_cases(raw)
    return out.select("case_id", F.array_join("expected_docs", "|").alias("expected"), "behavior", "split", F.length("question").cast("long").alias("n_chars"))


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit("INFO [time] "), "event_type", F.lit(" = "), F.format_string("%.2f", "value"), F.lit("s done")).alias("value"))
    return readers.stage_log(lines).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("total"))


_T = f"(SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS document_id, {TITLE_SQL} AS title, text AS content, lang, source FROM documents)"
_KEY = "lower(trim(title || '||' || content))"
_BAD = "title = '' OR content = '' OR length(content) < 200 OR length(title) > 150"

QUERIES = {
    "record_text": record_text, "resolve_records": resolve_records, "number_rows": number_rows, "validate_documents": validate_documents, "ingest_accounting": ingest_accounting, "data_profile": data_profile,
    "document_chunks": document_chunks, "record_chunks": record_chunks, "field_chunks": field_chunks, "exact_dedup": exact_dedup, "near_pairs": near_pairs, "near_dedup": near_dedup, "index_rows": index_rows,
    "upsert_index": upsert_index, "incremental_ingest": incremental_ingest, "page_text": page_text, "source_changes": source_changes, "labelled_cases": labelled_cases, "stage_log": stage_log,
}

# at sf0.01 every near vector has one partner, so each pair decides itself
_PAIRS = """WITH e AS (SELECT vec_id AS r, embedding FROM embeddings),
    v AS (SELECT r, CAST(embedding AS DOUBLE[]) AS x FROM e UNION ALL
      SELECT r + 1000000, CAST(list_transform(embedding, lambda y, i: CAST(y * (1.0 + 0.2 * ((i - 1) % 3 - 1)) AS FLOAT)) AS DOUBLE[]) FROM e WHERE r % 5 = 0),
    p AS (SELECT a.r AS i, b.r AS j, round(list_cosine_similarity(a.x, b.x), 4) AS sim FROM v a JOIN v b ON a.r < b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.95)"""
_UUID = """lower(concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], (['8','9','a','b'])[((strpos('0123456789abcdef', h[17]) - 1) & 3) + 1] || h[18:20], h[21:32]))"""

ORACLES = {
    "record_text": "SELECT p_partkey, concat_ws(chr(10), 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size) AS record FROM part",
    "resolve_records": """SELECT printf('DOC_%04d', c_custkey) AS document_id, c_name AS title, c_mktsegment AS category, c_name || '|' || c_mktsegment AS aliases,
        'Tiêu đề: ' || c_name || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS content FROM customer""",
    "number_rows": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row_index FROM documents",
    "validate_documents": f"""SELECT row_index, document_id, concat_ws(',', CASE WHEN title = '' THEN 'title:required' END, CASE WHEN content = '' THEN 'content:required' END,
        CASE WHEN length(content) < 200 THEN 'content:min_length' END, CASE WHEN length(title) > 150 THEN 'title:max_length' END) AS errors FROM {_T} WHERE {_BAD}""",
    "ingest_accounting": f"""WITH t AS (SELECT *, ({_BAD}) AS bad FROM {_T}), d AS (SELECT *, row_number() OVER (PARTITION BY bad, {_KEY} ORDER BY row_index) AS n FROM t)
        SELECT lang AS domain, count(*) AS loaded, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad AND n = 1) AS kept,
        count(*) FILTER (NOT bad AND n > 1) AS removed FROM d GROUP BY lang""",
    "data_profile": """SELECT 'doc_id,text,lang' AS columns, (SELECT string_agg(t, '||' ORDER BY doc_id) FROM (SELECT doc_id, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS t
        FROM documents ORDER BY doc_id LIMIT 2)) AS sample, count(*) AS n_rows FROM documents""",
    "document_chunks": f"""WITH p AS (SELECT document_id, title, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM {_T}),
        f AS (SELECT document_id, title, content, CASE WHEN length(content) <= 1200 OR len(ps) = 0 THEN [content] ELSE
          list_append((r).done, array_to_string((r).cur, chr(10))) END AS parts FROM (
          SELECT *, list_reduce(list_transform(ps, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': [x], 'size': length(x) + 1}}), lambda a, b:
            CASE WHEN a.size + b.size > 1200 THEN {{'done': list_append(a.done, array_to_string(a.cur, chr(10))),
              'cur': list_concat(a.cur[len(a.cur) + 1 - list_max(list_filter(range(0, len(a.cur) + 1), lambda m: coalesce(list_sum(list_transform(a.cur[len(a.cur) + 1 - m:], lambda y: length(y))), 0) <= 200)):], b.cur),
              'size': CAST(list_max(list_transform(list_filter(range(0, len(a.cur) + 1), lambda m: coalesce(list_sum(list_transform(a.cur[len(a.cur) + 1 - m:], lambda y: length(y))), 0) <= 200),
                 lambda m: coalesce(list_sum(list_transform(a.cur[len(a.cur) + 1 - m:], lambda y: length(y))), 0))) + b.size AS BIGINT)}}
            ELSE {{'done': a.done, 'cur': list_concat(a.cur, b.cur), 'size': CAST(a.size + b.size AS BIGINT)}} END) AS r FROM p)),
        c AS (SELECT document_id, title, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM f),
        o AS (SELECT document_id || '_doc_' || i AS chunk_id, CASE WHEN starts_with(t, title) THEN t ELSE 'Tài liệu: ' || title || chr(10) || t END AS t FROM c)
        SELECT chunk_id, length(t) AS n_chars, md5(t) AS text_md5 FROM o WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''""",
    "record_chunks": """SELECT p_partkey || '_general' AS chunk_id, 'Tiêu đề: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'p_type: ' || p_type || chr(10) || 'Tên gọi khác: ' || replace(p_name, ' ', ', ') AS text FROM part""",
    "field_chunks": """SELECT p_partkey || '_docs' AS chunk_id, 'required_documents' AS field, 'required_documents' AS inferred, 'Tên: ' || p_name || chr(10) || 'Docs:' || chr(10) || p_type || chr(10) || p_brand AS text FROM part
        UNION ALL SELECT p_partkey || '_fee', 'fee', 'fee', 'Tên: ' || p_name || chr(10) || 'Fee:' || chr(10) || p_brand FROM part WHERE p_size > 25
        UNION ALL SELECT p_partkey || '_general', 'general', 'general', p_name || ' ' || p_type FROM part""",
    "exact_dedup": f"SELECT row_index, document_id, 'content' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY row_index) AS n FROM {_T}) WHERE n > 1",
    "near_pairs": f"{_PAIRS} SELECT i, j, sim FROM p",
    "near_dedup": f"""{_PAIRS}, d AS (SELECT *, i % 7 AS a, j % 7 AS b FROM p)
        SELECT CASE WHEN a < b THEN i ELSE j END AS removed, CASE WHEN a < b THEN j ELSE i END AS kept, sim FROM d""",
    "index_rows": f"SELECT document_id, {_UUID} AS point_id, sha256(content) AS hash FROM (SELECT *, sha1(unhex('{index_store.DNS_NAMESPACE}') || encode(document_id || '_doc_1')) AS h FROM {_T})",
    "upsert_index": f"""SELECT {_UUID} AS point_id, chunk_id, md5(t) AS text_md5 FROM (SELECT *, sha1(unhex('{index_store.DNS_NAMESPACE}') || encode(chunk_id)) AS h FROM (
        SELECT document_id || '_doc_1' AS chunk_id, content AS t FROM {_T} UNION ALL SELECT document_id || '_doc_2', 'new ' || title FROM {_T} UNION ALL SELECT document_id || '_doc_3', content || ' new' FROM {_T}))""",
    "page_text": """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""",
    "source_changes": f"SELECT lang AS domain, document_id AS path, sha256(content) AS hash FROM {_T} WHERE row_index % 3 = 0 OR row_index % 5 = 0",
    "labelled_cases": """SELECT CAST(item_id AS VARCHAR) AS case_id, CASE WHEN item_id % 8 = 1 THEN NULL WHEN item_id % 4 = 1 THEN 'PROC_1|PROC_2' WHEN item_id % 4 = 2 THEN 'PROC_3' END AS expected,
        CASE WHEN item_id % 8 = 1 THEN 'REJECT' END AS behavior, CASE WHEN item_id % 2 = 0 THEN 'held_out' ELSE 'golden' END AS split, length(text) AS n_chars FROM benchmark""",
    "stage_log": "SELECT event_type AS stage, count(*) AS n, round(sum(round(value, 2)), 2) AS total FROM events GROUP BY event_type",
}
_KEPT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY row_index) AS n FROM {_T} WHERE NOT ({_BAD})) WHERE n = 1)"
ORACLES["incremental_ingest"] = ORACLES["document_chunks"].replace(_T, _KEPT)
