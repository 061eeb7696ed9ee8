import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import chunking, dedup, normalize
from lodestone.operators.components import connected_components
from lodestone.sources import index_store


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=20), st.integers(20, 90), st.integers(0, 40))
def test_packing_follows_its_rules(sizes, longest, overlap):
    paragraphs = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
    text = "\n".join(paragraphs)
    got = chunking.pack_paragraphs(text, longest, overlap)
    kept = [p for p in paragraphs if p]
    if len(text) <= longest or not kept:
        assert got == [text]
        return
    # rebuilt from the rule, one paragraph at a time
    chunks, cur, size = [], [], 0
    for p in kept:
        if cur and size + len(p) + 1 > longest:
            chunks.append(cur)
            tail, room = [], overlap
            for q in reversed(cur):
                if len(q) > room:
                    break
                room -= len(q)
                tail = [q, *tail]
            cur, size = tail, sum(map(len, tail))
        cur, size = [*cur, p], size + len(p) + 1
    assert got == ["\n".join(c) for c in [*chunks, cur]]


def test_chunk_ids_and_fields(spark):
    docs = spark.createDataFrame([("P1", "Title", "a b", "10", None, "Title body", ["x", "y"])], "document_id string, title string, required_documents string, fee string, notes string, content string, aliases array<string>")
    specs = [chunking.FieldSpec("required_documents", "_docs", "Docs", merge_with=("notes",)), chunking.FieldSpec("fee", "_fee", "Fee"), chunking.FieldSpec("notes", "_n", "N")]
    got = {r.chunk_id: r.text for r in chunking.route(docs, specs).collect()}
    assert got == {"P1_docs": "Tên: Title\nDocs:\na b", "P1_fee": "Tên: Title\nFee:\n10", "P1_general": "Title body\nTên gọi khác: x, y"}
    plain = docs.withColumn("source_type", F.lit("document"))
    assert [r.chunk_id for r in chunking.route(plain, [], []).collect()] == ["P1_doc_1"]


def _first_wins(rows):
    ids, keys, gone = set(), set(), set()
    for o, a, b in rows:
        if (a and a in ids) or b in keys:
            gone.add((o, "document_id" if a and a in ids else "content"))
        else:
            ids.add(a)
            keys.add(b)
    return gone


@pytest.mark.parametrize("rounds", [20, 1])
def test_exact_dedup_chains(spark, rounds):
    r = random.Random(4)
    for trial in range(3):
        rows = [(i, f"d{r.randint(0, 12)}", f"c{r.randint(0, 12)}") for i in range(40)] if trial else [(1, "1", "h1"), (2, "2", "h1"), (3, "2", "h2"), (4, "1", "h2"), (5, "3", "h2")]
        rows += [(100, None, "n1"), (101, None, "n2"), (102, None, "n1"), (103, "", "n3"), (104, "", "n4"), (105, "d1", "n4")]
        docs = spark.createDataFrame([(o, a, "t", b) for o, a, b in rows], "row_index long, document_id string, title string, content string")
        kept, removed = dedup.exact(docs, rounds=rounds)
        assert {(x.row_index, x.reason) for x in removed.collect()} == _first_wins(rows)
        assert kept.count() + removed.count() == len(rows)


@pytest.mark.parametrize("rounds", [20, 1])
def test_near_dedup_is_greedy_in_row_order(spark, rounds):
    rng = np.random.RandomState(3)
    base = rng.standard_normal((6, 16))
    rows = []
    for i in range(40):
        v = base[rng.randint(6)] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.25])
        rows.append((i, str(i), "x" * int(rng.randint(1, 5)), [float(x) for x in v]))
    docs = spark.createDataFrame(rows, "row_index long, document_id string, content string, embedding array<float>")
    x = np.array([r[3] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims, gone, log = x @ x.T, set(), set()
    for i in range(40):
        for j in range(i + 1, 40):
            if i in gone:
                break
            if j not in gone and sims[i, j] >= 0.95:
                loser, winner = (i, j) if len(rows[i][2]) < len(rows[j][2]) else (j, i)
                gone.add(loser)
                log.add((loser, winner))
    kept, removed = dedup.near(docs, rounds=rounds)
    assert {(r.removed, r.kept) for r in removed.collect()} == log and kept.count() == 40 - len(gone)


def test_near_dedup_of_a_path_and_of_equal_rows(spark):
    """A path of vectors, each near the next only, needs a round for each link; 300 equal ones are decided in a few."""
    path = [(i, str(i), "x" * (1 + i % 3), [math.cos(0.25 * i), math.sin(0.25 * i), 0.0, 0.0]) for i in range(12)]
    equal = [(100 + i, "e", "x" * (1 + (7 * i) % 5), [0.0, 0.0, 1.0, 0.5]) for i in range(300)]
    docs = spark.createDataFrame(path + equal, "row_index long, document_id string, content string, embedding array<double>")
    rows, gone, log = path + equal, set(), set()
    for a, (i, _, s, _) in enumerate(rows):
        for j, _, t, _ in rows[a + 1 :]:
            if i in gone:
                break
            if j not in gone and (j == i + 1 if i < 100 else j >= 100):
                loser, winner = (i, j) if len(s) < len(t) else (j, i)
                gone.add(loser)
                log.add((loser, winner))
    for rounds in (20, 3):
        _, removed = dedup.near(docs, rounds=rounds)
        assert {(r.removed, r.kept) for r in removed.collect()} == log


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_validation_ids_titles(spark):
    df = spark.createDataFrame([(" 7 ", "T"), ("x", None), (None, " ")], "i string, t string")
    ids = [r[0] for r in df.select(normalize.resolve_id([F.col("i")], F.lit(3))).collect()]
    assert ids == ["DOC_0007", "x", "DOC_0003"]
    good, bad = normalize.validate(df, normalize.required("t"))
    assert good.count() == 1 and [[e.rule for e in r.errors] for r in bad.collect()] == [["required"], ["required"]]
    assert normalize.map_columns([" ID ", "Foo", "Category"]) == (" ID ", "Foo", "Category", None)


def test_points_are_uuid5_and_upsert_is_idempotent(spark):
    df = spark.createDataFrame([("P1_fee", "a"), ("P2_é", "b")], "chunk_id string, text string")
    points = df.withColumn("point_id", index_store.point_id(F.col("chunk_id")))
    assert {r.point_id for r in points.collect()} == {str(uuid.uuid5(uuid.NAMESPACE_DNS, c)) for c in ("P1_fee", "P2_é")}
    new = spark.createDataFrame([("P1_fee", "new")], "chunk_id string, text string")
    once = index_store.upsert(points, new)
    twice = index_store.upsert(once, new)
    assert {(r.chunk_id, r.text) for r in twice.collect()} == {("P1_fee", "new"), ("P2_é", "b")}
    fit, unfit = index_store.check_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "id string, embedding array<double>"), 2)
    assert fit.count() == 1 and {r.error for r in unfit.collect()} == {"wrong_dimension", "missing_vector"}


def test_near_pairs_of_vectors_that_do_not_fit(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 2.0, 0.001]), (5, [1.0, None]), (6, None), (7, [0.0, 0.0]), (8, [])]
    docs = spark.createDataFrame(rows, "row_index long, embedding array<float>")
    assert sorted((r.i, r.j) for r in dedup.near_pairs(docs).collect()) == [(1, 2), (3, 4)]
    assert dedup.near_pairs(docs.limit(0)).count() == 0
