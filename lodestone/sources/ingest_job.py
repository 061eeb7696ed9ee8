"""Incremental ingest as one job: load, validate, drop duplicates, chunk, upsert and mark, with one commit at the end."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators import chunking, dedup, normalize
from lodestone.runtime import materialize
from lodestone.sources import readers
from lodestone.sources.index_store import IndexStore, upsert


class Ingested(NamedTuple):
    """What a run did, in rows; `changed` counts the sources that were new or had changed."""

    changed: int
    loaded: int
    valid: int
    kept: int
    chunks: int


def documents_of(raw: DataFrame) -> DataFrame:
    """Records of any source as (row_index, document_id, title, content): roles by column name, rows numbered from 1 in the
    order of the sources."""
    columns = [c for c in raw.columns if c not in ("source_no", "source_path", "source_type", "raw_text")]
    role = normalize.map_columns(columns)
    rows = materialize(raw.withColumn("_at", F.monotonically_increasing_id()), "records")
    rows = normalize.number_rows(rows, ["_at"])
    of = lambda c: [F.col(c)] if c else []
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    others = [c for c in columns if c not in (role.document_id, "content")]
    title = normalize.resolve_title([c.cast("string") for c in of(role.title)], [F.col(c).cast("string") for c in columns], has("source_path"), F.col("row_index"))
    rows = rows.withColumns({"_id": normalize.resolve_id(of(role.document_id), F.col("row_index")), "_title": title})
    content = normalize.enrich_content(has("content").cast("string"), has("raw_text"), F.col("_title"), others)
    return rows.select("row_index", F.col("_id").alias("document_id"), F.col("_title").alias("title"), content.alias("content"))


def source_hashes(spark: SparkSession, domain: str, sources: Sequence[Mapping[str, str]]) -> DataFrame:
    """(domain, path, hash) of all files of the sources."""
    paths = [readers.fingerprints(readers.read_files(spark, c["path"])) for c in sources]
    files = paths[0]
    for more in paths[1:]:
        files = files.unionByName(more)
    return files.distinct().select(F.lit(domain).alias("domain"), "path", "hash")


def ingest(
    store: IndexStore, domain: str, sources: Sequence[Mapping[str, str]], batch: int | None = None, force: bool = False, rules: Sequence[normalize.Rule] | None = None, documents: Callable[[DataFrame], DataFrame] = documents_of,
    chunks: Callable[[DataFrame], DataFrame] = chunking.document_chunks, files: DataFrame | None = None, kinds: Mapping[str, readers.Reader] = readers.READERS,
) -> Ingested:
    """Brings the domain's index up to date with its sources, if any of them is new or has changed (or by force, which begins
    with an empty index).

    The new index, the marks of the sources and the number of the batch become visible in one commit at the end. So a run
    that is killed at any place, also between upsert and mark, leaves the old state, and the next run does all of it; a batch
    that was committed isn't run again. files(domain, path, hash) are the sources' files where they are known already.
    Chunks of documents that are no longer in the sources stay, as points are upserted by id, unless force is set."""
    manifest = store.manifest()
    if batch is not None and batch <= manifest["batches"].get(domain, -1):
        return Ingested(0, 0, 0, 0, 0)
    spark = store.spark
    current = materialize(files if files is not None else source_hashes(spark, domain, sources), "hashes")
    registry = store.registry()
    changed = readers.changed_sources(current, registry.filter(F.col("domain") == domain)).count()
    done = manifest | ({"batches": manifest["batches"] | {domain: batch}} if batch is not None else {})
    if not changed and not force:
        if batch is not None:
            store.commit(done)
        return Ingested(0, 0, 0, 0, 0)
    docs = materialize(documents(readers.read_sources(spark, sources, kinds)), "documents")
    valid, _ = normalize.validate(docs, rules if rules is not None else normalize.required("title", "content"))
    kept, removed = dedup.exact(materialize(valid, "valid"))
    new = chunking.drop_blank(chunks(kept)).select("document_id", "chunk_id", "title", "text").withColumn("domain", F.lit(domain))
    new = materialize(new, "chunks")
    n_valid, n_chunks = valid.count(), new.count()
    result = Ingested(changed, docs.count(), n_valid, n_valid - removed.count(), n_chunks)
    if n_chunks:  # sources without a chunk aren't marked
        old = None if force or domain not in manifest["domains"] else store.index(domain)
        empty = spark.createDataFrame([], new.withColumn("point_id", F.lit("")).schema)
        folder = store.write(upsert(old if old is not None else empty, new), f"domain-{len(manifest['domains'])}")
        marked = store.write(readers.mark_indexed(registry, current, F.current_timestamp()), "registry")
        store.commit(done | {"domains": manifest["domains"] | {domain: folder}, "registry": marked})
    return result


def ingest_stream(spark: SparkSession, store: IndexStore, domain: str, kind: str, folder: str, checkpoint: str, pattern: str = "*", **options) -> StreamingQuery:
    """Runs ingest() for the files of a folder that have arrived since the last run, as one batch of the stream; a batch that
    Spark runs again after a failure changes nothing if it was committed. Other options go to ingest()."""
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder)

    def run(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            ingest(store, domain, [{"type": kind, "path": f"{folder}/{pattern}"} | {k: v for k, v in options.items() if k == "schema"}], batch, **{k: v for k, v in options.items() if k != "schema"})

    return arrived.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(run).start()
