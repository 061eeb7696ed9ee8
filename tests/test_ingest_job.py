"""The ingest job: replays, runs that die between upsert and mark, changed sources, purges, the stream of files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import ingest_job, readers
from lodestone.sources.index_store import IndexStore

SCHEMA = "id string, name string, content string"


def put(path, records):
    path.write_text(json.dumps(records))


def rows_of(store, domain=None):
    found = store.index(domain)
    return set() if found is None else {(r.domain, r.chunk_id, r.text) for r in found.collect()}


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json", [{"id": "1", "name": "One", "content": "first"}, {"id": "2", "name": "Two", "content": "second"}, {"id": "2", "name": "Twice", "content": "third"}, {"name": "No id", "content": "x"}])
    return tmp_path, IndexStore(spark, str(tmp_path / "index")), [{"type": "json", "path": str(tmp_path / "in/*.json"), "schema": SCHEMA}]


def test_a_batch_is_taken_once(spark, place):
    _, store, sources = place
    first = ingest_job.ingest(store, "food", sources, batch=0)
    assert first == ingest_job.Ingested(1, 4, 4, 3, 3)
    assert {(d, c) for d, c, _ in rows_of(store)} == {("food", "DOC_0001_doc_1"), ("food", "DOC_0002_doc_1"), ("food", "DOC_0004_doc_1")}
    before = store.manifest()
    assert ingest_job.ingest(store, "food", sources, batch=0).loaded == 0 and store.manifest() == before  # a replay
    assert ingest_job.ingest(store, "food", sources, batch=1).loaded == 0 and store.manifest()["batches"] == {"food": 1}  # nothing new
    assert ingest_job.ingest(store, "food", sources, force=True).kept == 3
    assert {r.path.rsplit("/", 1)[1] for r in store.registry().collect()} == {"a.json"} and store.registry().count() == 1


def test_a_run_that_dies_before_the_mark_changes_nothing(spark, place, monkeypatch):
    tmp_path, store, sources = place
    ingest_job.ingest(store, "food", sources, batch=0)
    before, marks = rows_of(store), store.registry().collect()
    put(tmp_path / "in/b.json", [{"id": "3", "name": "Three", "content": "new"}, {"id": "1", "name": "One", "content": "changed"}])
    with monkeypatch.context() as m:
        m.setattr(IndexStore, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed after the upsert")))
        with pytest.raises(OSError, match="killed"):
            ingest_job.ingest(store, "food", sources, batch=1)
    assert rows_of(store) == before and store.registry().collect() == marks
    ingest_job.ingest(store, "food", sources, batch=1)
    again = rows_of(store)
    assert {c for _, c, _ in again} == {f"DOC_000{i}_doc_1" for i in (1, 2, 3, 4)} and store.registry().count() == 2
    assert store.vacuum() and rows_of(store) == again and store.vacuum() == []


def test_two_jobs_can_not_both_commit(spark, place):
    _, store, _ = place
    old = store.manifest()
    store.commit(old | {"batches": {"a": 1}})
    with pytest.raises(RuntimeError, match="another job"):
        store.commit(old | {"batches": {"b": 1}})
    assert store.manifest()["batches"] == {"a": 1}


def test_purge_drops_one_domain_and_its_marks(spark, place):
    _, store, sources = place
    for domain in ("food", "food_asia"):
        ingest_job.ingest(store, domain, sources)
    kept = rows_of(store, "food_asia")
    store.purge("food")
    assert rows_of(store) == kept and len(kept) == 3
    assert {r.domain for r in store.registry().collect()} == {"food_asia"}
    assert ingest_job.ingest(store, "food", sources).kept == 3 and len(rows_of(store)) == 6


def test_files_that_arrive_are_ingested_once(spark, place):
    tmp_path, store, _ = place
    run = lambda: ingest_job.ingest_stream(spark, store, "food", "json", str(tmp_path / "in"), str(tmp_path / "cp"), "*.json", schema=SCHEMA).awaitTermination(120)
    assert run() and len(rows_of(store)) == 3
    put(tmp_path / "in/c.json", [{"id": "9", "name": "Nine", "content": "new"}])
    assert run() and len(rows_of(store)) == 4 and store.manifest()["batches"] == {"food": 1}
    assert run() and store.manifest()["batches"] == {"food": 1}


def test_json_files_that_are_no_arrays_of_objects(spark, tmp_path):
    bad = {"object.json": '{"id": "1"}', "items.json": '[{"id": "2"}, 3]', "text.json": '["{\\"id\\": 4}"]', "broken.json": "[{", "empty.json": "[]"}
    for name, text in {**bad, "good.json": '﻿[{"id": "5"}, {"name": null}]'}.items():
        (tmp_path / name).write_text(text)
    rows, broken = readers.read_json(spark, str(tmp_path / "*.json"), spark.createDataFrame([], SCHEMA).schema)
    assert {r.source_path.rsplit("/", 1)[1]: r.reason for r in broken.collect()} == {"object.json": "not_array", "items.json": "not_object", "text.json": "not_object", "broken.json": "not_json"}
    assert [(r.id, r.source_type) for r in rows.orderBy(F.desc_nulls_last("id")).collect()] == [("5", "tabular"), (None, "tabular")]
    assert readers.read_sources(spark, [{"type": "json", "path": str(tmp_path / "good.json"), "schema": SCHEMA}]).count() == 2
