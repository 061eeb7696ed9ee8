"""Sources: JSON and CSV records, web pages, dispatch, file checks, fingerprints, labelled cases, stage logs, reports."""

from __future__ import annotations

import html
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestone.functions.text import blank_to_null
from lodestone.operators.normalize import record_text


def read_json(spark: SparkSession, path: str, schema: StructType, source_type: str = "tabular") -> tuple[DataFrame, DataFrame]:
    """(rows, broken): the records of files that are JSON arrays of objects. Files that aren't go whole to broken(source_path,
    raw_text, reason): not_json, not_array, or not_object if any item isn't one."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw_text"))
    parsed = files.withColumn("_v", F.try_parse_json(F.regexp_replace("raw_text", "^\ufeff", "")))
    items = F.try_variant_get("_v", "$", "array<variant>")
    reason = F.when(F.col("_v").isNull(), "not_json").when(items.isNull(), "not_array").when(F.exists(items, lambda x: ~F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT")), "not_object")
    judged = parsed.withColumn("reason", reason)
    each = judged.filter("reason is null").select("source_path", F.explode(F.from_json(F.regexp_replace("raw_text", "^\ufeff", ""), ArrayType(schema))).alias("_r"))
    rows = each.select("_r.*", "source_path")
    kind = F.coalesce(blank_to_null(F.col("source_type")), F.lit(source_type)) if "source_type" in schema.names else F.lit(source_type)
    return rows.withColumn("source_type", kind), judged.filter("reason is not null").select("source_path", "raw_text", "reason")


def read_csv(spark: SparkSession, path: str, source_type: str = "tabular") -> DataFrame:
    """Records with trimmed headers and values, all strings, and their text as 'column: value' lines. A byte order mark is
    skipped; columns without a name are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    names = [(c, c.replace("﻿", "").strip()) for c in df.columns]
    kept = [(c, n) for c, n in names if n and not n.startswith("_c")]
    out = df.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in kept], F.col("_metadata.file_path").alias("source_path"))
    return out.withColumns({"raw_text": record_text([n for _, n in kept]), "source_type": F.lit(source_type)})


def html_text(c: Column) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags go, entities are decoded, space is collapsed."""
    bare = reduce(lambda acc, p: F.regexp_replace(acc, p, " "), (r"(?is)<!--.*?-->", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", r"(?s)<[^>]*>"), c)
    return F.trim(F.regexp_replace(_unescape(bare), r"\s+", " "))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_text_native(c: Column) -> Column:
    """As html_text() with the five named entities and &nbsp; only, in built-in functions."""
    bare = reduce(lambda acc, p: F.regexp_replace(acc, p, " "), (r"(?is)<!--.*?-->", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", r"(?s)<[^>]*>"), c)
    names = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return F.trim(F.regexp_replace(reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), names, bare), r"\s+", " "))


def read_pages(pages: DataFrame, native: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of pages(url, html): a page without text is skipped, not fatal."""
    out = pages.select(F.col("url").alias("source_url"), (html_text_native if native else html_text)(F.col("html")).alias("raw_text"))
    good = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    return out.filter(good), out.filter(~good)


Reader = Callable[[SparkSession, Mapping[str, str]], DataFrame]
READERS: dict[str, Reader] = {
    "json": lambda spark, cfg: read_json(spark, cfg["path"], StructType.fromDDL(cfg["schema"]))[0],
    "csv": lambda spark, cfg: read_csv(spark, cfg["path"]),
    "parquet": lambda spark, cfg: spark.read.parquet(cfg["path"]),
    "web": lambda spark, cfg: read_pages(spark.read.parquet(cfg["path"]))[0],
}


def read_sources(spark: SparkSession, configs: Sequence[Mapping[str, str]], readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """All sources of the configuration, one after the other (source_no keeps their order)."""
    parts = [readers[c["type"]](spark, c).withColumn("source_no", F.lit(i)) for i, c in enumerate(configs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")


def check_files(files: DataFrame, known: Sequence[str] = ("json", "csv", "pdf", "docx", "xlsx", "txt"), most: int = 20 << 20) -> DataFrame:
    """files(path, content, length) with ok and reason. (Spark's file listing leaves out files without a byte.)"""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.try_validate_utf8("content")
    parsed = F.try_parse_json(F.when(kind == "json", text))
    reason = (
        F.when(~kind.isin(*known), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > most, "too_large")
        .when((kind == "json") & parsed.isNull(), "not_json")
        .when((kind == "csv") & text.isNull(), "not_utf8")
        .when((kind == "csv") & F.contains(F.hex("content"), F.lit("00")) & F.col("content").cast("string").contains("\x00"), "nul_byte")
        .when((kind == "pdf") & (F.substring(F.hex("content"), 1, 10) != "255044462D"), "not_pdf")
    )
    return files.select("path", "length", reason.isNull().alias("ok"), reason.alias("reason"))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("hash"))


def folder_fingerprints(files: DataFrame, folder: Column, relative: Column) -> DataFrame:
    """(folder, hash): over the sorted relative paths, each with its file's hash."""
    h = F.struct(relative.alias("rel"), F.sha2("content", 256).alias("h"))
    one = files.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list(h)).alias("x"))
    return one.select("folder", F.sha2(F.array_join(F.transform("x", lambda x: F.concat(x["rel"], x["h"])), ""), 256).alias("hash"))


def changed_sources(current: DataFrame, registry: DataFrame) -> DataFrame:
    """current(domain, path, hash) rows that the registry doesn't have with that hash."""
    old = registry.select("domain", "path", F.col("hash").alias("_old"))
    return current.join(old, ["domain", "path"], "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def mark_indexed(registry: DataFrame, indexed: DataFrame, now: Column) -> DataFrame:
    """The registry(domain, path, hash, indexed_at) with the newest row of each source."""
    rows = registry.unionByName(indexed.select("domain", "path", "hash").withColumn("indexed_at", now))
    newest = Window.partitionBy("domain", "path").orderBy(F.desc("indexed_at"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


# What stands for no document.
NO_DOCUMENT = ("NONE", "NULL", "OUT_OF_SCOPE", "CLARIFY", "CLARIFY/NONE", "")


def parse_expected(single: Column, several: Column | None = None) -> Column:
    """array<string> of expected documents from a list, or a text with commas; null where it says none."""
    listed = F.filter(F.transform(several, lambda x: F.trim(x)), lambda x: x != "") if several is not None else F.lit(None).cast("array<string>")
    split = F.filter(F.transform(F.split(single, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(listed) > 0, listed).when(~F.upper(F.trim(F.coalesce(single, F.lit("")))).isin(*NO_DOCUMENT), split)


def load_cases(cases: DataFrame, split: str | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Labelled cases of either layout as (case_id, question, expected_docs, expected_field, keywords, behavior, split);
    with most, a seeded draw of that many, sorted by id."""
    has = lambda c, kind="string": F.col(c) if c in cases.columns else F.lit(None).cast(kind)
    listed = has("expected_documents", "array<string>")
    out = cases.select(
        F.col("id").alias("case_id"), F.coalesce(has("question"), has("query")).alias("question"), parse_expected(has("expected_document_id"), listed).alias("expected_docs"), has("expected_field").alias("expected_field"),
        F.coalesce(has("expected_keywords", "array<string>"), F.array().cast("array<string>")).alias("keywords"), has("expected_behavior").alias("behavior"), F.coalesce(has("split"), F.lit("golden")).alias("split"),
    )
    out = out.withColumn("expected_docs", F.when(F.upper("behavior").isin("REJECT", "OUT_OF_SCOPE", "CLARIFY"), None).otherwise(F.col("expected_docs")))
    if split:
        out = out.filter(F.col("split") == split)
    return out.orderBy(F.xxhash64("case_id", F.lit(seed)), "case_id").limit(most).orderBy("case_id") if most else out


def stage_log(lines: DataFrame, c: str = "value") -> DataFrame:
    """(stage, seconds) of every '[time] stage = 1.23s' in the lines."""
    found = F.explode(F.regexp_extract_all(c, F.lit(r"(\[time\]\s*[^=\n]+?\s*=\s*[0-9.]+\s*s)"), F.lit(1)))
    rows = lines.select(found.alias("x"))
    return rows.select(F.trim(F.regexp_extract("x", r"\[time\]\s*([^=\n]+?)\s*=", 1)).alias("stage"), F.try_to_number(F.regexp_extract("x", r"=\s*([0-9.]+)\s*s", 1), F.lit("999999999.999999")).cast("double").alias("seconds"))


def write_report(details: DataFrame, summary: DataFrame, path: str) -> None:
    """Details as CSV and JSON, the summary as JSON, below path."""
    flat = details.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in details.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/details_csv")
    details.write.mode("overwrite").json(f"{path}/details_json")
    summary.write.mode("overwrite").json(f"{path}/summary")
