import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import evaluate, ranking, search, telemetry, verify


def test_verdicts(spark):
    ev = spark.createDataFrame([("q", "EC_001", "D1", "T1", "Lệ phí đăng ký khai sinh là 8.000 đồng"), ("q", "EC_002", "D2", "T2", "Không cần nộp bản sao giấy tờ. Thời hạn giải quyết 3 ngày")], "query_id string, candidate_id string, document_id string, title string, content string")
    answer = "Thông tin:\nLệ phí khai sinh là 8000 đồng.\nThời hạn giải quyết 5 ngày.\nCần nộp bản sao giấy tờ.\nHoàn toàn khác biệt lạ lùng.\nThời hạn giải quyết [EC_002]"
    got = {r.claim_no: r for r in verify.verify(spark.createDataFrame([("q", answer), ("none", "x y"), ("empty", None)], "query_id string, answer string"), ev).collect() if r.query_id == "q"}
    assert [got[i].status for i in range(1, 7)] == ["supported", "supported", "unsupported", "unsupported", "unsupported", "supported"]
    assert got[3].conflict == "number" and got[4].conflict == "negation" and got[6].evidence_ids == ["EC_002"] and got[1].header
    v = verify.verify(spark.createDataFrame([("q", answer)], "query_id string, answer string"), ev)
    kept = verify.filter_answers(v).first()
    assert kept.critical and kept.n_kept == 3 and kept.answer.startswith("Thông tin:")
    cites = {r.claim_no: [c.document_id for c in r.citations] for r in verify.map_citations(v, ev).collect()}
    assert cites[2] == ["D1"] and cites[6] == ["D2"]


def test_selection_fills_places(spark):
    hits = [("q", f"{d}{i}", d, f, s) for d, i, f, s in [("A", 1, "fee", 0.9), ("A", 2, "fee", 0.8), ("A", 3, "required_documents", 0.7), ("A", 4, "general", 0.6), ("B", 1, "general", 0.95), ("B", 2, "fee", 0.5), ("C", 1, "general", 0.4)]]
    h = spark.createDataFrame(hits, "query_id string, chunk_id string, document_id string, field string, retrieval_score double")
    s = spark.createDataFrame([("q", "A", 2.0), ("q", "B", 1.0), ("q", "C", 0.5)], "query_id string, document_id string, doc_score double")
    pick = lambda fields, k=5: [r.chunk_id for r in ranking.select_chunks(h, s, spark.createDataFrame([("q", fields)], "query_id string, fields array<string>"), k).orderBy("place").collect()]
    assert pick(["fee", "docs"]) == ["A1", "A2", "A3", "A4", "B2"]
    assert pick(["fee"], 6) == ["A1", "A2", "A4", "B2", "C1"]
    assert pick(["time"]) == ["A4", "B1", "C1"]
    assert pick([]) == ["A1", "A2", "A3", "A4", "B1"]


def test_mentions_take_long_names_first(spark):
    catalog = spark.createDataFrame([("P1", "Khai sinh"), ("P2", "Đăng ký khai sinh"), ("P3", "Kết hôn"), ("P4", "sinh"), (None, "x"), ("P5", None)], "document_id string, alias string")
    texts = spark.createDataFrame([(1, "và ket hon, đăng ký khai sinh"), (2, "khai sinhx"), (3, None), (4, "khai sinh và sinh")], "query_id long, text string")
    for shard in (200_000, 1):  # one automaton, or one for each name or so
        found = ranking.mentions(texts, catalog, shard)
        got = sorted((r.query_id, r.found_no, r.document_id) for r in found.collect())
        # inside words too; the longest name first, whose span shorter ones can't use
        assert got == [(1, 1, "P2"), (1, 2, "P3"), (2, 1, "P1"), (4, 1, "P1"), (4, 2, "P4")]
    subs = ranking.sub_queries(found, texts.select("query_id", F.array(F.lit("fee")).alias("fields")), 1)
    assert {(r.query_id, r.sub_no, r.document_id, r.truncated) for r in subs.collect()} == {(1, 1, "P2", True), (2, 1, "P1", False), (3, 1, None, False), (4, 1, "P1", True)}


def test_mentions_equal_one_scan_after_another(spark):
    r = random.Random(8)
    letters = "abé đ"
    names = [("".join(r.choice(letters) for _ in range(r.randint(1, 5))), f"D{r.randrange(12):02}") for _ in range(40)]
    texts = [(i, "".join(r.choice(letters + "ABÉ") for _ in range(r.randint(0, 30)))) for i in range(150)]

    def plainly(text):
        """Every alias looked for in turn, by the longest first, in the text with what was found blanked."""
        marks = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn").strip()
        forms = sorted({(f, d) for a, d in names for f in {a.lower().strip(), marks(a)} if f}, key=lambda x: (-len(x[0]), x[1], x[0]))
        both, seen = [text.lower(), marks(text)], []
        for alias, doc in forms:
            at = next((t.find(alias) for t in both if alias in t), -1) if doc not in seen else -1
            if at >= 0:
                both = [t[:at] + " " * len(alias) + t[at + len(alias) :] for t in both]
                seen.append(doc)
        return seen

    found = ranking.mentions(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame(names, "alias string, document_id string"), shard=15, at_once=500)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.found_no)):
        got.setdefault(x.query_id, []).append(x.document_id)
    assert got == {i: d for i, t in texts if (d := plainly(t))}


def test_sub_questions_are_resolved(spark):
    hit = lambda q, no, chunk, doc, title, score, rank, field="fee": (q, no, chunk, doc, title, field, score, rank)
    subs = spark.createDataFrame(
        [(1, 1, "Pass", "Pass", ["fee"], False), (1, 2, "Visa", "Visa", ["fee"], False), (2, 1, "how", None, [], False), (3, 1, "tell me all about the long matter", None, ["fee", "docs"], False), (4, 1, "none", "none", [], True), (5, 1, "x y", None, [], False)],
        "query_id long, sub_no int, mention string, hint string, fields array<string>, truncated boolean",
    )
    hits = spark.createDataFrame(
        [
            hit(1, 1, "a1", "A", "Passport", 0.1, 1), hit(1, 1, "b1", "B", "Other", 0.9, 2), hit(1, 2, "c1", "C", "x", 0.7, 1), hit(1, 2, "d1", "D", "The Visa", 0.6, 2), hit(1, 2, "d2", "D", "The Visa", 0.95, 3, "general"),
            hit(2, 1, "e1", "E", "e", 0.90, 1), hit(2, 1, "f1", "F", "f", 0.88, 2), hit(3, 1, "e1", "E", "e", 0.90, 1, "general"), hit(3, 1, "f1", "F", "f", 0.95, 2), hit(3, 1, "e2", "E", "e", 0.2, 3), hit(3, 1, "e3", "E", "e", 0.3, 4), hit(3, 1, "e4", "E", "e", 0.1, 5, "required_documents"),
            hit(5, 1, "g1", "G", "g", 0.42, 1, "general"), hit(5, 1, "h1", "H", "h", 0.2, 2),
        ],
        "query_id long, sub_no int, chunk_id string, document_id string, title string, field string, retrieval_score double, rank int",
    )
    done = ranking.resolve_sub_queries(subs, hits, vague=F.col("mention").isin("how", "Visa"))
    got = {(r.query_id, r.sub_no): (r.status, r.document_id, r.title, round(r.score, 3)) for r in done.collect()}
    assert got[(1, 1)] == ("NOT_FOUND", None, "Passport", 0.1)  # named, but its score is too low
    assert got[(1, 2)] == ("FOUND", "D", "The Visa", 0.6)  # named, with that hit's score; 0.7 and 0.6 aren't close
    assert got[(2, 1)] == ("AMBIGUOUS", None, None, 0.9)  # close and vague
    assert got[(3, 1)] == ("FOUND", "E", "e", 1.08)  # close, not vague; general chunks weigh more
    assert got[(4, 1)] == ("NOT_FOUND", None, None, 0.0) and got[(5, 1)] == ("FOUND", "G", "g", 0.504)
    chunks = {}
    for r in sorted(ranking.resolved_chunks(done, hits).collect(), key=lambda r: (r.query_id, r.sub_no, r.place)):
        chunks.setdefault((r.query_id, r.sub_no), []).append(r.chunk_id)
    assert chunks == {(1, 2): ["d1", "d2"], (3, 1): ["e3", "e4", "e1"], (5, 1): ["g1"]}
    plan = {r.query_id: (r.found, r.missing, r.n_sub, r.truncated) for r in ranking.answer_plan(done).collect()}
    assert plan == {1: (["The Visa"], ["Passport"], 2, False), 2: ([], ["how"], 1, False), 3: (["e"], [], 1, False), 4: ([], ["none"], 1, True), 5: (["g"], [], 1, False)}



def test_bonuses(spark):
    df = spark.createDataFrame([("lệ phí khai sinh", "Đăng ký khai sinh", "phí khai sinh 0đ", ["khai sinh"])], "q string, t string, c string, a array<string>")
    r = df.select(ranking.keyword_bonus(F.col("q"), F.col("t"), F.col("c")).alias("k"), ranking.alias_bonus(F.col("q"), F.col("a")).alias("al"), ranking.ngram_bonus(F.col("q"), F.col("c")).alias("n"), ranking.field_bonus(F.array(F.lit("fee")), F.lit("fee")).alias("f")).first()
    assert round(r.k, 2) == 0.66 and r.al == 0.85 and round(r.n, 2) == 0.14 and r.f == 0.55


def test_vector_search_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(30)], "chunk_no long, embedding array<float>")
    got = search.vector_top_k(v, v.filter("chunk_no < 2").withColumnRenamed("chunk_no", "query_id"), 3, "dot")
    assert {r.chunk_no for r in got.filter("query_id = 1").collect()} == {29, 28, 27}


def test_grading(spark):
    rows = spark.createDataFrame(
        [("Phí 5 đồng khai sinh", False, ["A"], "Phí 5 đồng khai sinh", "Phí 5 đồng"), ("Phí 9 đồng khai sinh", False, ["A"], "Phí 5 đồng khai sinh", "Phí 5 đồng"), ("Phí 5 đồng", False, ["B"], "Phí 5 đồng", ""), ("x", True, [], "y", ""), ("tờ khai mẫu", False, [], "tờ khai mẫu ảnh chân dung", "tờ khai mẫu;ảnh chân dung")],
        "answer string, rejected boolean, cited_ids array<string>, source_text string, field_text string",
    ).withColumn("expected_ids", F.array(F.lit("A")))
    assert [r.verdict for r in evaluate.grade(rows).collect()] == ["DUNG", "SAI", "SAI", "TU_CHOI_NHAM", "THIEU"]
    s = evaluate.verdict_summary(evaluate.grade(rows)).first()
    assert s.correct_pct == 20.0 and s.correct_rejection_pct == 0.0


def test_slope_and_rates_are_null_without_data(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    assert df.agg(telemetry.slope(F.col("y"), F.col("x"))).first()[0] is None
    assert df.agg(telemetry.rate(F.lit(1), F.lit(0))).first()[0] is None


def test_phrases_are_found_wherever_a_chunk_holds_them(spark):
    texts = ["the overcoat rack", "a coat", "Über den Überfluss", "what ?! now", "coat racks stand here", "", None, "a red coat rack", "x"]
    asked = ["coat rack", "coat", "ÜBER", "?!", "red coat rack", "", None, "zz", "oat ra", "x", "--"]
    chunks = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "chunk_id long, title string, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = search.build_index(chunks)
    low = lambda t: (t or "").lower().replace("ü", "u")
    want = {(q, c) for q, a in enumerate(asked) for c, t in enumerate(texts) if low(a) and low(a) in low(t)}
    none = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    got = search.phrase_bonus(none, index, queries, chunks)
    assert {(r.query_id, r.chunk_id): r.score for r in got.collect()} == dict.fromkeys(want, 1.2)
    held = {(q, c) for q, a in enumerate(asked) for c, t in enumerate(texts) if a and t and a in t}
    assert {tuple(r) for r in search.containing(queries, chunks, index).collect()} == held


def test_vector_search_equals_brute_force_in_any_number_of_blocks(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(60, 8)
    x[10] = x[20]  # a tie
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(99, None)], "chunk_no long, embedding array<double>").repartition(3)
    asked = v.filter("chunk_no % 4 = 0 or chunk_no = 99").withColumnRenamed("chunk_no", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for at_once in (4096, 4):
        got = search.vector_top_k(v, asked, 5, at_once=at_once).collect()
        for q in range(0, 60, 4):
            s = (unit @ unit[q]).round(9)
            assert [r.chunk_no for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(60), -s))[:5].tolist()
        assert {r.query_id for r in got} == set(range(0, 60, 4))
    assert search.vector_top_k(v, asked.filter("false"), 5).count() == 0


def test_vectors_of_other_lengths_and_text_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.5]), ("c", [1.0, 0.0, 2.0]), ("d", None), ("e", []), ("f", [1.0, None])], "chunk_no string, embedding array<double>")
    asked = spark.createDataFrame([("q2", [2.0, 0.0]), ("q3", [0.0, 0.0, 1.0]), ("q4", [1.0] * 4), ("q0", None)], "query_id string, embedding array<double>")
    got = search.vector_top_k(v, asked, 5, held=2).collect()  # a batch of its own for each few vectors
    assert {(r.query_id, r.chunk_no, r["rank"]) for r in got} == {("q2", "a", 1), ("q2", "b", 2), ("q3", "c", 1)}


def test_missing_chunks_and_aliases(spark):
    chunks = spark.createDataFrame([("A", f"A{i:02}") for i in range(25)] + [("B", "B00")], "document_id string, chunk_id string")
    best = spark.createDataFrame([(1, "A"), (2, "B")], "query_id long, document_id string")
    hits = spark.createDataFrame([(1, "A00"), (1, "B00"), (2, "B00")], "query_id long, chunk_id string")
    got = [(r.query_id, r.chunk_id) for r in search.missing_chunks(best, hits, chunks).collect()]
    assert sorted(got) == [(1, f"A{i:02}") for i in range(1, 21)]
    records = spark.createDataFrame([("A", ["Pass ", "PASS", " ", None]), ("B", []), ("C", None)], "document_id string, aliases array<string>")
    assert [tuple(r) for r in search.alias_catalog(records).collect()] == [("A", "pass")]


def test_answers_from_templates_and_evidence(spark):
    evidence = spark.createDataFrame(
        [(1, "EC_001", "A", "Pass", "fee", "Tên: Pass\n10 euro", 1), (1, "EC_002", "B", "Visa", "time", "2 days", 2), (1, "EC_003", "A", "Pass", "time", "Tên: Pass\n3 days", 3), (1, "EC_004", "A", "Pass", "general", "all of it", 4), (2, "EC_001", "B", "Visa", "fee", "free", 1)],
        "query_id long, candidate_id string, document_id string, title string, field string, content string, rank int",
    )
    fields = spark.createDataFrame([(1, ["time", "fee"]), (2, ["fee", "time"]), (3, ["fee"])], "query_id long, fields array<string>")
    assert {r.query_id: r.answer for r in verify.template_answers(evidence, fields).collect()} == {1: "Pass:\n3 days [EC_003]\n10 euro [EC_001]"}  # 2 has no time
    none = verify.template_answers(evidence, spark.createDataFrame([(1, []), (2, ["fee"] * 3)], "query_id long, fields array<string>"))
    assert none.count() == 0
    got = {r.query_id: r.answer for r in verify.evidence_answers(evidence).collect()}
    assert got == {1: "Visa\n2 days [EC_002]\n\nPass\nall of it [EC_004]", 2: "Visa\nfree [EC_001]"}
