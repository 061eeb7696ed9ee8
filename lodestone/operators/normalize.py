"""Records to documents: column roles, ids, titles, content, validation, profiles and accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to_null

# Header names that mark a column's role, most telling first.
ID_NAMES = ("document_id", "id", "stt", "mã", "ma", "code")
TITLE_NAMES = ("title", "name", "tên", "ten", "tiêu đề", "tieu de", "tên thủ tục", "procedure_name", "subject", "label", "heading", "tên món", "dish", "product", "chủ đề", "topic")
CATEGORY_NAMES = ("category", "loại", "loai", "nhóm", "nhom", "type", "lĩnh vực", "danh mục")
ALIAS_NAMES = ("aliases", "alias", "tên khác", "ten khac", "keywords")
SYSTEM_KEYS = ("document_id", "title", "content", "raw_text", "aliases", "source_type", "row_index")


class ColumnMapping(NamedTuple):
    document_id: str | None
    title: str | None
    category: str | None
    aliases: str | None


def map_columns(columns: Sequence[str]) -> ColumnMapping:
    """Roles by header name, compared in lower case without outer spaces. The title falls back to the first column that
    isn't the id, then to the first."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    role = lambda names: next((known[n] for n in names if n in known), None)
    own = role(ID_NAMES)
    title = role(TITLE_NAMES) or next((c for c in columns if c != own), columns[0] if columns else None)
    return ColumnMapping(own, title, role(CATEGORY_NAMES), role(ALIAS_NAMES))


def number_rows(df: DataFrame, key: Sequence[str | Column], source: str | None = None, ranges: int = 256, name: str = "row_index") -> DataFrame:
    """1-based numbers in the order of key, for each source, without one task for all rows: rows are cut into ranges of
    the first key column, and each range's numbers begin after the rows of the ranges before it."""
    by = [source] if source else []
    first = key[0] if isinstance(key[0], Column) else F.col(key[0])
    bounds = df.select(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    placed = df.withColumn("_range", F.when(first.isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda x: x <= first))))
    before = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*by, "_range", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*key))
    return placed.withColumn("_inside", inside).join(F.broadcast(before) if not by else before, [*by, "_range"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")


def record_text(columns: Sequence[str], labels: Mapping[str, str] | None = None) -> Column:
    """'column: value' lines of the columns that aren't blank."""
    line = lambda c: F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.concat(F.lit(f"{(labels or {}).get(c, c)}: "), F.trim(F.col(c).cast("string"))))
    return F.concat_ws("\n", *[line(c) for c in columns])


def resolve_id(candidates: Sequence[Column], row_number: Column) -> Column:
    """The first candidate that isn't blank; all digits become DOC_0001 style; without one the row number does."""
    raw = F.coalesce(*[blank_to_null(c.cast("string")) for c in candidates], F.lit(None).cast("string"))
    numbered = F.format_string("DOC_%04d", F.try_to_number(raw, F.lit("9" * 18)).cast("bigint"))
    return F.when(raw.isNull(), F.format_string("DOC_%04d", row_number.cast("bigint"))).when(raw.rlike("^[0-9]{1,18}$"), numbered).otherwise(raw)


def resolve_title(candidates: Sequence[Column], texts: Sequence[Column], source_path: Column | None, row_number: Column, longest: int = 150) -> Column:
    """The first candidate that isn't blank, else the first short text, else a numbered title if any text is there."""
    named = F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(None).cast("string"))
    filled = F.filter(F.array(*[blank_to_null(c) for c in texts]), lambda x: x.isNotNull()) if texts else F.array().cast("array<string>")
    short = F.get(F.filter(filled, lambda x: F.length(x) <= longest), F.lit(0))
    stem = F.regexp_extract(source_path, r"([^/\\]*?)(\.[^./\\]*)?$", 1) if source_path is not None else F.lit("")
    numbered = F.when(stem != "", F.concat(stem, F.lit(" - Mục "), row_number.cast("string"))).otherwise(F.concat(F.lit("Tài liệu "), row_number.cast("string")))
    return F.coalesce(named, short, F.when(F.size(filled) > 0, numbered))


def resolve_category(candidates: Sequence[Column], default: str = "chung") -> Column:
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(default))


def parse_aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|\n]"), lambda x: F.trim(x)), lambda x: x != "")


def enrich_content(content: Column, raw_text: Column, title: Column, others: Sequence[str]) -> Column:
    lines = F.concat_ws("\n", F.concat(F.lit("Tiêu đề: "), title), *([record_text(others)] if others else []))
    return F.coalesce(F.nullif(content, F.lit("")), blank_to_null(raw_text), lines)


class Rule(NamedTuple):
    field: str
    name: str
    holds: Column


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, error rows): the latter with errors array<struct<field, rule>>; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"))) for r in rules]))
    checked = df.withColumn("errors", broken)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def required(*fields: str) -> list[Rule]:
    return [Rule(f, "required", blank_to_null(F.col(f).cast("string")).isNotNull()) for f in fields]


def profile(df: DataFrame, order: str, rows: int = 2, longest: int = 120) -> DataFrame:
    """One row: columns, the first rows with long values cut, and the number of rows."""
    cut = lambda c: F.when(F.length(F.col(c).cast("string")) > longest, F.concat(F.substring(F.col(c).cast("string"), 1, longest), F.lit("..."))).otherwise(F.col(c).cast("string"))
    first = df.orderBy(order).limit(rows).select(F.struct(*[cut(c).alias(c) for c in df.columns]).alias("r"), F.col(order).alias("o"))
    sample = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("sample"))
    return sample.crossJoin(df.agg(F.count("*").alias("n_rows"))).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))


def accounting(stages: Mapping[str, DataFrame], by: str = "domain") -> DataFrame:
    """Rows of each stage by group, one column for each stage."""
    counts = None
    for name, df in stages.items():
        part = df.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(name).alias("stage"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts.groupBy(by).pivot("stage", list(stages)).agg(F.sum("n")).na.fill(0)
