import random

import corpus_pipeline
from lodestone.llm import simhash


def test_fingerprints_of_rows_without_id_link_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", "fp"))
    docs = spark.createDataFrame([(7, 0), (None, 0b111), (5, 0b111111), (None, 0xFFFFFF << 30)], "doc_id long, fp long")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert got == {(7, f"{0:016x}"): 5, (None, f"{7:016x}"): 5, (5, f"{63:016x}"): 5, (None, f"{0xFFFFFF << 30:016x}"): None}


def test_rows_with_null_or_repeated_ids_stay_unless_they_are_copies(spark):
    r = random.Random(2)
    a, b, c, d = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (3, b), (5, b), (5, c), (None, d), (9, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == {(None, a), (3, b), (5, c), (9, d)}
