import itertools
import re

import corpus_pipeline
from lodestone.llm import langid, mixing, quality

SF = "/root/testdata/sf0.001"


def first_of_groups(texts):
    """The least id of each group of texts that five-word shingles with a similarity of 0.8 or more connect, pair by pair."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return sorted(set(label.values()))


def test_each_stage_does_its_own_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    one = steps["quality rules"](spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()} and one.columns == docs.columns
    two = steps["language ID"](spark, one, SF)
    assert {r.doc_id for r in two.collect()} <= {r.doc_id for r in one.collect()} and two.count() >= 0.99 * one.count()
    three = steps["SimHash near-dedup"](spark, two, SF)
    assert sorted(r.doc_id for r in three.collect()) == first_of_groups({r.doc_id: r.text for r in two.collect()})
    four = steps["mixing sources to target weights"](spark, three, SF)
    assert four.columns == docs.columns
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(three).collect()}
    for r in four.groupBy("doc_id").count().collect():
        assert abs(r["count"] - taken[r.doc_id]) <= 0.5
    five = steps["SentencePiece encoding and decoding"](spark, four, SF)
    assert five.count() == four.count() and five.filter("not round_trip").count() == 0
    assert langid.SCRIPTS[0] == "LATIN"
