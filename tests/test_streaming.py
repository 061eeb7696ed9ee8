import datetime
import random
import tempfile
import time

from pyspark.sql import functions as F

from lodestone.operators import dialog, telemetry
from lodestone.streaming import jobs


def _stream(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(dir="/tmp")).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name)


def _hits(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), 1_700_000_000 + r.randint(0, 400)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, client string, s long").select("event_id", "client", F.timestamp_seconds("s").alias("ts"))
    allowed = {}
    for c in "ab":
        admitted = []
        for i, _, s in sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[0])):
            allowed[i] = sum(s - a < 60 for a in admitted) < 5
            if allowed[i]:
                admitted.append(s)
    return df, allowed


def test_admission_batch_and_stream(spark, tmp_path):
    df, want = _hits(spark)
    assert {r.event_id: r.allowed for r in jobs.admission_batch(df, 5, 60.0).collect()} == want
    got = _drain(jobs.admission_stream(_stream(spark, df.coalesce(1), str(tmp_path / "h")), 5, 60.0), "admitted")
    assert {r.event_id: r.allowed for r in got.collect()} == want
    assert jobs.admission_batch(df, 0).filter("not allowed").count() == 0


def test_session_stream_equals_batch_fold(spark, tmp_path):
    rows = [("s1", 1, "a", None, ["x"]), ("s1", 2, None, "m", ["y", "x"]), ("s1", 3, "b", None, []), ("s2", 1, None, None, ["z"])]
    df = spark.createDataFrame(rows, "session_id string, turn int, intent string, method string, documents array<string>")
    batch = dialog.fold_slots(df, slots=("intent", "method"))
    got = _drain(jobs.session_stream(_stream(spark, df.coalesce(1), str(tmp_path / "t")), ("intent", "method")), "sessions")
    as_set = lambda d: {(r.session_id, r.turn, r.intent, r.method, tuple(r.documents)) for r in d.collect()}
    assert as_set(got) == as_set(batch) and ("s1", 3, "b", "m", ("x", "y")) in as_set(got)


def _events(spark, rows):
    df = spark.createDataFrame([(*x[:4], float(x[4])) for x in rows], "request_id string, seq long, event string, data string, s double")
    return df.select("request_id", "seq", "event", "data", F.timestamp_micros(((F.col("s") + 1_700_000_000) * 1_000_000).cast("long")).alias("ts"))


def test_rollup_stream_gives_what_the_batch_rollup_gives(spark, tmp_path):
    rows = [("r1", 0, "start", None, 0), ("r1", 2, "chunk", '{"text": "b"}', 2), ("r1", 1, "chunk", '{"text": "a"}', 1), ("r1", 3, "evidence", '{"document_id": "D1"}', 3), ("r2", 0, "clarification", "{}", 1)]
    df = _events(spark, [*rows, ("late", 0, "done", '{"answer": "x"}', 10_000)])
    got = _drain(jobs.rollup_stream(_stream(spark, df.coalesce(1), str(tmp_path / "e"))), "rolled_whole")
    want = telemetry.request_rollup(df.filter("request_id <> 'late'")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.request_id, r.answer, r.needs_clarification, tuple(r.doc_ids)) for r in got.collect()} == {("r1", "ab", False, ("D1",)), ("r2", "", True, ())}


def test_rollup_stream_keeps_requests_whole_over_batches_and_out_of_order(spark, tmp_path):
    """Files come one by one: requests cross any span border, events come late within the watermark, and after the end."""
    r = random.Random(3)
    rows = []
    for i in range(40):
        begin = r.uniform(0, 3000) if i else 595.0  # request 0 goes over the border of a ten-minute span
        size = r.randint(0, 5)
        rows += [(f"r{i}", k, "chunk", f'{{"text": "{k}-{i} "}}', begin + 4 * k) for k in range(size)]
        if i % 3:
            rows.append((f"r{i}", size, "done", '{"answer": "", "citations": [{"document_id": "D\\u00e9"}]}', begin + 4 * size + 1))
    rows = [x for x in rows if x[0] != "r5"] + [("end", 0, "done", "{}", 30_000.0)]
    order = sorted(rows, key=lambda x: x[4] + r.uniform(0, 120))  # up to two minutes late
    want = telemetry.request_rollup(_events(spark, rows).filter("request_id <> 'end'"))
    path = str(tmp_path / "files")
    for k in range(0, len(order), 9):
        _events(spark, order[k : k + 9]).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    files = spark.readStream.schema(_events(spark, rows).schema).option("maxFilesPerTrigger", 4).parquet(path)
    got = _drain(jobs.rollup_stream(files, late="3 minutes", timeout=300.0), "rolled_files")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert got.filter("done").first().doc_ids == ["Dé"]


def test_events_after_the_end_open_no_second_request(spark, tmp_path):
    path = str(tmp_path / "files")
    for rows in ([("a", 0, "chunk", '{"text": "x"}', 0.0), ("a", 1, "done", "{}", 1.0)], [("b", 0, "done", "{}", 200.0)], [("c", 0, "done", "{}", 210.0), ("a", 2, "chunk", '{"text": "y"}', 150.0)], [("d", 0, "done", "{}", 90_000.0)]):
        _events(spark, rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    files = spark.readStream.schema(_events(spark, [("a", 0, "x", "{}", 0.0)]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(jobs.rollup_stream(files, late="1 minute"), "rolled_late").collect()
    assert sorted((r.request_id, r.answer) for r in got) == [("a", "x"), ("b", ""), ("c", "")]


def test_nested_ids_are_found_with_escapes(spark):
    data = [
        ('{"a": [{"document_id": "x\\"y"}, {"b": {"document_id" : "z"}}], "text": "\\"document_id\\": \\"no\\""}', ['x"y', "z"]), ('{"document_id": 5}', []), ("not json \"document_id\": \"q\"", []), (None, []),
        ('["document_id", {"document_id": "\\u0041"}]', ["A"]),
    ]
    got = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(data)], "i int, d string").select("i", telemetry.document_ids(F.col("d")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: w for i, (_, w) in enumerate(data)}


def test_admission_by_segments_equals_one_pass(spark):
    """Bursts with gaps around the window, clients that never reach the limit, equal times, a null client."""
    r = random.Random(6)
    rows, t = [], 0.0
    for i in range(900):
        t += r.choice([0.0, 0.5, 3.0, 9.75, 10.0, 10.25, 45.0])
        rows.append((i, r.choice(["hot", "hot", "hot", "cold", None]), int(t * 1e6)))
    df = spark.createDataFrame(rows, "event_id long, client string, us long").select("event_id", "client", F.timestamp_micros("us").alias("ts"))
    want = {}
    for c in ("hot", "cold", None):
        own = sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[0]))
        want |= dict(zip((x[0] for x in own), jobs.admit([x[2] for x in own], 3, 10_000_000)[0], strict=True))
    got = {x.event_id: x.allowed for x in jobs.admission_batch(df, 3, 10.0).collect()}
    assert got == want and not all(want.values())
    timed = df.select(F.col("client").alias("_key"), F.unix_micros("ts").alias("_t"))
    cells = jobs._segments(timed, 3, 10_000_000).filter("_key = 'hot'").collect()
    assert len({x._segment for x in cells}) > 20 and not all(x._decide for x in cells)


def test_idle_sessions_go_and_snapshots_go_on(spark, tmp_path):
    schema = "session_id string, turn int, intent string, method string, documents array<string>, ts timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC).replace(tzinfo=None)
    path = str(tmp_path / "turns")
    for rows in ([("s1", 1, "a", None, ["x"], at(0)), ("s2", 1, "k", None, [], at(0))], [("s1", 2, None, "m", None, at(50))], [("s9", 1, None, None, [], at(5000))], [("s1", 3, None, None, ["y"], at(5010)), ("s3", 7, None, None, ["n"], at(5010))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    start = spark.createDataFrame([("s3", "old", "way", ["o"])], "session_id string, intent string, method string, documents array<string>")
    got = _drain(jobs.session_stream(turns, ("intent", "method"), at="ts", idle=600.0, late="1 minute", initial=start), "idle_sessions").collect()
    by = {(r.session_id, r.turn): (r.intent, r.method, tuple(r.documents)) for r in got}
    assert by[("s1", 2)] == ("a", "m", ("x",)) and by[("s1", 3)] == (None, None, ("y",))  # the first s1 had gone
    assert by[("s3", 7)] == ("old", "way", ("o", "n")) and by[("s2", 1)] == ("k", None, ()) and len(by) == 6
