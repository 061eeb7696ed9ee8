"""Documents to chunks: paragraph packing with overlap, field, record and document chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.text import blank_to_null
from lodestone.operators.normalize import record_text


def pack_paragraphs(text: str, longest: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily. A chunk's size counts one more for each paragraph put to it, but not for those carried
    over from the chunk before, which are its last ones that fit into the overlap. A paragraph is never cut."""
    if len(text) <= longest:
        return [text]
    paragraphs = [x for x in map(str.strip, text.split("\n")) if x]
    chunks: list[str] = []
    begin = at = size = 0  # paragraphs[begin:at] are in the open chunk
    for at, p in enumerate(paragraphs):
        if at > begin and size + len(p) + 1 > longest:
            chunks.append("\n".join(paragraphs[begin:at]))
            size, keep = 0, at
            while keep > begin and size + len(paragraphs[keep - 1]) <= overlap:
                keep -= 1
                size += len(paragraphs[keep])
            begin = keep
        size += len(p) + 1
    if paragraphs:
        chunks.append("\n".join(paragraphs[begin:]))
    return chunks or [text]


def split_long(c: Column, longest: int = 1400, overlap: int = 200, rows: int = 256) -> Column:
    """array<string> of the chunks of a text. Short texts stay in the JVM as they are; of the others a worker holds so many of a
    batch as strings at once, beside the batch and its result."""

    def pack(texts: pa.Array) -> pa.Array:
        one = lambda t: None if t is None else pack_paragraphs(t, longest, overlap)
        parts = (pa.array([one(t) for t in texts.slice(i, rows).to_pylist()], pa.list_(pa.string())) for i in range(0, max(len(texts), 1), rows))
        return pa.concat_arrays(parts)

    short = F.length(c) <= longest
    return F.when(short, F.array(c)).otherwise(F.arrow_udf(pack, ArrayType(StringType()))(F.when(~short, c)))


def starts_with_title(text: Column, title: Column, label: str, anywhere: bool) -> Column:
    own = F.concat(F.lit(f"{label}: "), title)
    found = F.startswith(text, title) | (F.contains(text, title) if anywhere else F.lit(False))
    return F.when(found, text).otherwise(F.concat(own, F.lit("\n"), text))


def _number(df: DataFrame, parts: str, base: Column, always: bool) -> DataFrame:
    """A row for each part; ids get _1, _2, ... if there are several (or always)."""
    several = F.lit(True) if always else F.col("_n") > 1
    out = df.withColumn("_n", F.size(parts)).select("*", F.posexplode(parts).alias("_i", "text"))
    return out.withColumn("chunk_id", F.when(several, F.concat(base, F.lit("_"), (F.col("_i") + 1).cast("string"))).otherwise(base)).drop("_i", "_n", parts)


def document_chunks(docs: DataFrame, longest: int = 1200, overlap: int = 200, label: str = "Tài liệu") -> DataFrame:
    """(document_id, title, chunk_id, text) of long documents; docs has document_id, title, content."""
    parts = docs.withColumn("_parts", split_long(F.col("content"), longest, overlap))
    out = _number(parts, "_parts", F.concat("document_id", F.lit("_doc")), True)
    return out.withColumn("text", starts_with_title(F.col("text"), F.col("title"), label, False)).withColumn("field", F.lit("general"))


def record_chunks(records: DataFrame, extra: Sequence[str], longest: int = 2500, overlap: int = 200, label: str = "Tiêu đề") -> DataFrame:
    """One chunk for each record: title line, 'column: value' lines (else the content), alias line; split if very long."""
    lines = record_text(extra) if extra else F.lit("")
    body = F.when(lines != "", lines).otherwise(F.coalesce(blank_to_null(F.col("content")), F.lit(""))) if "content" in records.columns else lines
    lines_of = [F.concat(F.lit(f"{label}: "), F.col("title")), F.nullif(body, F.lit(""))]
    if "aliases" in records.columns:
        lines_of.append(F.when(F.size("aliases") > 0, F.concat(F.lit("Tên gọi khác: "), F.array_join("aliases", ", "))))
    whole = F.concat_ws("\n", *lines_of)
    short, long = records.withColumn("_w", whole).filter(F.length("_w") <= longest), records.withColumn("_w", whole).filter(F.length("_w") > longest)
    parts = short.withColumn("_parts", F.array("_w")).unionByName(long.withColumn("_parts", split_long(F.col("_w"), longest, overlap))).drop("_w")
    return _number(parts, "_parts", F.concat("document_id", F.lit("_general")), False).withColumn("field", F.lit("general"))


class FieldSpec(NamedTuple):
    field: str
    suffix: str
    label: str
    columns: tuple[str, ...] = ()  # 'column: value' lines; else the field's own column
    merge_with: tuple[str, ...] = ()


def field_chunks(docs: DataFrame, specs: Sequence[FieldSpec], longest: int = 1400, overlap: int = 200, title_label: str = "Tên") -> DataFrame:
    """A chunk for each configured field that isn't empty."""

    def body(s: FieldSpec) -> Column:
        own = record_text(s.columns) if s.columns else blank_to_null(F.col(s.field))
        return F.concat_ws("\n", F.nullif(own, F.lit("")), *[blank_to_null(F.col(m)) for m in s.merge_with])

    each = F.array(*[F.struct(F.lit(s.field).alias("field"), F.lit(s.suffix).alias("suffix"), F.lit(s.label).alias("label"), body(s).alias("body")) for s in specs])
    rows = docs.select("*", F.explode(F.filter(each, lambda x: F.trim(x["body"]) != "")).alias("_f"))
    whole = F.concat(F.lit(f"{title_label}: "), F.col("title"), F.lit("\n"), F.col("_f.label"), F.lit(":\n"), F.col("_f.body"))
    rows = rows.withColumns({"field": F.col("_f.field"), "_base": F.concat("document_id", F.col("_f.suffix")), "_parts": split_long(whole, longest, overlap)}).drop("_f")
    return _number(rows, "_parts", F.col("_base"), False).drop("_base")


def general_chunks(docs: DataFrame, extra: Sequence[str] = (), longest: int = 1400, overlap: int = 200, label: str = "Tiêu đề") -> DataFrame:
    """The general chunk beside the field chunks: content, else the record's lines; title first, alias line last."""
    lines = record_text(extra) if extra else F.lit(None).cast("string")
    body = F.coalesce(blank_to_null(F.col("content")), F.nullif(lines, F.lit("")))
    titled = starts_with_title(body, F.col("title"), label, True)
    whole = F.concat_ws("\n", titled, F.when(F.size("aliases") > 0, F.concat(F.lit("Tên gọi khác: "), F.array_join("aliases", ", ")))) if "aliases" in docs.columns else titled
    rows = docs.filter(body.isNotNull()).withColumns({"field": F.lit("general"), "_parts": split_long(whole, longest, overlap)})
    return _number(rows, "_parts", F.concat("document_id", F.lit("_general")), False)


def route(docs: DataFrame, specs: Sequence[FieldSpec], extra: Sequence[str] = ()) -> DataFrame:
    """All chunks that aren't blank: by field if a field besides 'general' is configured, else by source_type."""
    keep = ["document_id", "title", "chunk_id", "field", "text"]
    if len(specs) > 1 and any(s.field != "general" for s in specs):
        parts = [field_chunks(docs, [s for s in specs if s.field != "general"]), general_chunks(docs, extra)]
    else:
        kind = F.coalesce("source_type", F.lit("")) == "document"
        parts = [record_chunks(docs.filter(~kind), extra), document_chunks(docs.filter(kind))]
    return drop_blank(reduce(DataFrame.unionByName, [p.select(*keep) for p in parts]))


def drop_blank(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


# What an id's ending says about the field.
SUFFIX_FIELDS: Mapping[str, str] = {"docs": "required_documents", "fee": "fee", "time": "processing_time", "method": "submission_method", "general": "general"}


def infer_field(field: Column, chunk_id: Column) -> Column:
    known = F.when(field == "submission_location", F.lit("submission_method")).otherwise(blank_to_null(field))
    ending = F.regexp_extract(chunk_id, r"_(docs|fee|time|method|general)(?:_\d+)?$", 1)
    return F.coalesce(known, *[F.when(ending == k, F.lit(v)) for k, v in SUFFIX_FIELDS.items()])
