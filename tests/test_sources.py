from pyspark.sql import functions as F

from lodestone.sources import index_store, readers


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "x"}, {"id": "2", "title": null}]')
    (tmp_path / "b.json").write_text("[{broken")
    schema = spark.createDataFrame([], "id string, title string").schema
    rows, broken = readers.read_json(spark, str(tmp_path / "*.json"), schema)
    assert {r.id for r in rows.collect()} == {"1", "2"} and broken.count() == 1 and rows.first().source_type == "tabular"
    (tmp_path / "c.csv").write_bytes("﻿ id , name \n 1 , Ä\n 2 ,\n".encode())
    got = readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [(r.id, r["name"], r.raw_text) for r in got] == [("1", "Ä", "id: 1\nname: Ä"), ("2", None, "id: 2")]
    both = readers.read_sources(spark, [{"type": "csv", "path": str(tmp_path / "c.csv")}] * 2)
    assert {r.source_no for r in both.collect()} == {0, 1} and both.count() == 4


def test_pages(spark):
    pages = spark.createDataFrame([("u1", "<p>A&amp;B<script>x<y</script> &eacute;</p><!-- n -->"), ("u2", "<br>"), ("u3", None)], "url string, html string")
    good, skipped = readers.read_pages(pages, native=False)
    assert [(r.source_url, r.raw_text) for r in good.collect()] == [("u1", "A&B é")] and skipped.count() == 2


def test_file_checks_and_fingerprints(spark, tmp_path):
    for name, data in {"a.json": b"[1]", "b.json": b"[", "c.csv": b"a\x00b", "d.csv": b"\xff", "e.pdf": b"%PDF-1", "f.pdf": b"x", "g.exe": b"x", "i.csv": b"a,b"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in readers.check_files(files).collect()}
    assert got == {"a.json": None, "b.json": "not_json", "c.csv": "nul_byte", "d.csv": "not_utf8", "e.pdf": None, "f.pdf": "not_pdf", "g.exe": "extension", "i.csv": None}
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    one = readers.folder_fingerprints(files, F.lit("x"), name).first().hash
    (tmp_path / "i.csv").write_bytes(b"a,c")
    assert readers.folder_fingerprints(readers.read_files(spark, str(tmp_path)), F.lit("x"), name).first().hash != one


def test_registry(spark):
    cur = spark.createDataFrame([("d", "p1", "a"), ("d", "p2", "b")], "domain string, path string, hash string")
    reg = spark.createDataFrame([("d", "p1", "a", "2024-01-01")], "domain string, path string, hash string, indexed_at string")
    changed = readers.changed_sources(cur, reg)
    assert [r.path for r in changed.collect()] == ["p2"]
    marked = readers.mark_indexed(reg, changed, F.lit("2024-02-01"))
    assert readers.changed_sources(cur, marked).count() == 0


def test_purge_gives_files_to_the_longest_domain(spark):
    files = spark.createDataFrame([("/x/food.csv",), ("/x/food_asia_1.csv",), ("/x/food_2.csv",), ("/x/other.csv",)], "path string")
    domains = spark.createDataFrame([("food",), ("food_asia",)], "domain string")
    used = spark.createDataFrame([("food_asia", "/x/food_2.csv")], "domain string, path string")
    assert [r.path for r in index_store.purge_files(files, domains, used, "food").collect()] == ["/x/food.csv"]


def test_cases_and_logs(spark):
    cases = spark.createDataFrame([("1", "q", "A, B", None), ("2", "q", "CLARIFY/NONE", None), ("3", "q", "A", "REJECT")], "id string, question string, expected_document_id string, expected_behavior string")
    got = {r.case_id: r.expected_docs for r in readers.load_cases(cases).collect()}
    assert got == {"1": ["A", "B"], "2": None, "3": None} and readers.load_cases(cases, most=2).count() == 2
    lines = spark.createDataFrame([("[time] a b = 1.5s x [time] c = 2s",), ("none",)], "value string")
    assert {(r.stage, r.seconds) for r in readers.stage_log(lines).collect()} == {("a b", 1.5), ("c", 2.0)}


def test_index_partitions_are_replaced_by_domain(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.write_index(spark.createDataFrame([("a", "d1"), ("b", "d2")], "chunk_id string, domain string"), path)
    index_store.write_index(spark.createDataFrame([("c", "d1")], "chunk_id string, domain string"), path)
    assert {r.chunk_id for r in spark.read.parquet(path).collect()} == {"b", "c"}
    readers.write_report(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"), spark.createDataFrame([(1,)], "n int"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary")).first().n == 1
