"""Streaming jobs and their batch twins: admission, session state, request rollup."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.telemetry import request_columns, seconds_of


def admit(times: Sequence[float], limit: int, window: float, held: Sequence[float] = ()) -> tuple[list[bool], list[float]]:
    """Which hits pass: those with under `limit` admitted hits in the window before them. Rejected hits don't count. Also
    the admitted hits that still matter. A limit of 0 or less admits everything."""
    if limit <= 0:
        return [True] * len(times), []
    queue, out = deque(held), []
    for t in times:
        while queue and t - queue[0] >= window:
            queue.popleft()
        out.append(len(queue) < limit)
        if out[-1]:
            queue.append(t)
    return out, list(queue)


def _segments(hits: DataFrame, limit: int, span: int) -> DataFrame:
    """(_key, _cell, _segment, _decide) of hits(_key, _t): a segment is a run of hits without a gap of the window or more, so
    its first hit finds an empty window; _decide: whether any two adjacent cells of the window's length hold more than limit
    hits. Cells are counted before the shuffle, so a key's hits never meet in a task."""
    cells = hits.groupBy("_key", F.floor(F.col("_t") / span).alias("_cell")).agg(F.min("_t").alias("_b"), F.max("_t").alias("_e"), F.count("*").alias("_n"))
    in_order = Window.partitionBy("_key").orderBy("_cell")
    before = F.lag(F.struct("_cell", "_e", "_n")).over(in_order)
    near = F.col("_n") + F.when(F.col("_p._cell") == F.col("_cell") - 1, F.col("_p._n")).otherwise(0)
    cells = cells.withColumn("_p", before).withColumns({"_new": F.coalesce(F.col("_b") - F.col("_p._e") >= span, F.lit(True)), "_near": near})
    cells = cells.withColumn("_segment", F.sum(F.col("_new").cast("long")).over(in_order))
    return cells.withColumn("_decide", F.max("_near").over(Window.partitionBy("_key", "_segment")) > limit).select("_key", "_cell", "_segment", "_decide")


def _decide(limit: int, span: int):
    """Goes through hits in the order of segments and times; a segment may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            own = [("NaN" if k != k else k, n) for k, n in zip(b["_key"].to_pylist(), b["_segment"].to_pylist(), strict=True)]
            times, allowed, begin = b["_t"].to_pylist(), [], 0
            for segment, some in groupby(own):
                end = begin + len(list(some))
                passed, held = admit(times[begin:end], limit, span, held if segment == now else [])
                allowed += passed
                now, begin = segment, end
            yield pa.RecordBatch.from_arrays([b["_key"], b["_tie"], pa.array(allowed, pa.bool_())], names=["_key", "_tie", "allowed"])

    return run


def admission_batch(hits: DataFrame, limit: int = 60, window: float = 60.0, key: str = "client", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """hits with allowed, decided in time order for each client; tie tells a client's hits apart.

    A client's hits fall into segments, before each of which its window is empty. Segments that never have more than `limit`
    hits within the window pass as they are; each of the others is decided on its own. A task goes through its segments in
    order and holds `limit` times, however many hits a segment has."""
    if limit <= 0:
        return hits.withColumn("allowed", F.lit(True))
    kinds, span = dict(hits.dtypes), int(window * 1e6)
    timed = hits.select(F.col(key).alias("_key"), F.col(tie).alias("_tie"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    known = _segments(timed, limit, span).filter("_decide").select(F.col("_key").alias("_k"), F.col("_cell").alias("_c"), "_segment")
    some = timed.join(known, F.col("_key").eqNullSafe(F.col("_k")) & (F.floor(F.col("_t") / span) == F.col("_c"))).select("_key", "_segment", "_tie", "_t")

    dealt = some.repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_t", "_tie")
    decided = dealt.mapInArrow(_decide(limit, span), f"_key {kinds[key]}, _tie {kinds[tie]}, allowed boolean")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie"))
    return hits.join(decided, same, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_key", "_tie")


def admission_stream(hits: DataFrame, limit: int = 60, window: float = 60.0, key: str = "client", at: str = "ts", tie: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """As admission_batch() on a stream; the state of a client is its admitted times, and goes when the watermark (the
    newest time less `late`) has passed its last hit by the window."""
    kinds, span = dict(hits.dtypes), int(window * 1e6)

    def step(client: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", tie])
        allowed, held = admit(rows["t"].tolist(), limit, span, held)
        state.update((held,))
        state.setTimeoutTimestamp(max(int(rows["t"].iloc[-1] + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: client[0], tie: rows[tie], "allowed": allowed})

    stamped = hits.withColumn("at_time", F.col(at).cast("timestamp")).withWatermark("at_time", late)
    timed = stamped.select(key, tie, "at_time", F.unix_micros("at_time").alias("t"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def _use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sessions(StatefulProcessor):
    """The slots and documents of each session so far; with times, they go `idle` after its last turn."""

    def __init__(self, key: str, order: str, slots: Sequence[str], idle: int | None, schema: str) -> None:
        self.key, self.order, self.slots, self.idle, self.schema = key, order, slots, idle, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        r = initialState.iloc[0]
        self.held.update((*[r[s] if isinstance(r[s], str) else None for s in self.slots], [] if r["documents"] is None else list(r["documents"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.idle and any(at <= timerValues.getCurrentWatermarkInMs() for at in self.handle.listTimers()):  # rows come before timers
            self.held.clear()
        before = self.held.get() if self.held.exists() else None
        held = dict(zip(self.slots, before[:-1], strict=True)) if before else dict.fromkeys(self.slots)
        docs, out, last = list(before[-1]) if before else [], [], 0
        for r in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            held |= {s: r[s] for s in self.slots if r[s] is not None}
            docs += [d for d in dict.fromkeys([] if r["documents"] is None else list(r["documents"])) if d not in docs]
            out.append({self.key: key[0], self.order: r[self.order], **held, "documents": list(docs)})
            last = max(last, r.get("at_ms", 0))
        self.held.update((*[held[s] for s in self.slots], docs))
        if self.idle:
            for at in list(self.handle.listTimers()):
                last = max(last, at - self.idle)
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(last, int(timerValues.getCurrentWatermarkInMs())) + self.idle)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()


def session_stream(turns: DataFrame, slots: Sequence[str], key: str = "session_id", order: str = "turn", at: str | None = None, idle: float = 86_400.0, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Each arriving turn with its session's slots so far; the batch twin is dialog.fold_slots().

    With a column of times, a session's state goes once the watermark has passed its last turn by `idle` seconds; a later
    turn begins anew. initial(session_id, slots, documents), as dialog.latest_state() gives it, is where sessions go on; such
    a session stays until its first turn."""
    kinds = dict(turns.dtypes)
    _use_rocksdb(turns.sparkSession)
    held = ", ".join(f"{s} string" for s in slots) + ", documents array<string>"
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {held}"
    own = turns.select(key, order, *slots, "documents", *([F.col(at).cast("timestamp").alias("at_time"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms")] if at else []))
    own = own.withWatermark("at_time", late) if at else own
    process = _Sessions(key, order, tuple(slots), int(idle * 1000) if at else None, held)
    start = initial.select(key, *slots, "documents").groupBy(key) if initial is not None else None
    return own.groupBy(key).transformWithStateInPandas(process, schema, "append", "EventTime" if at else "None", initialState=start)


EVENT = "seq bigint, t double, event string, data string"


class _Requests(StatefulProcessor):
    """The events of a request until it is done or silent; then its number and events leave as one row."""

    def __init__(self, key: str, timeout: int) -> None:
        self.key, self.timeout = key, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.times = handle.getValueState("times", "done bigint, last bigint")
        self.closed = handle.getValueState("closed", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = int(timerValues.getCurrentWatermarkInMs())
        if self.times.exists() and any(at <= watermark for at in self.handle.listTimers()):  # rows come before timers
            yield self._given_out(key, watermark)
        if self.closed.exists():  # what comes after a request was given out doesn't open it again
            return
        for pdf in rows:
            done, last = self.times.get() if self.times.exists() else (None, 0)
            done = max([done or 0, *pdf.loc[pdf["event"] == "done", "at_ms"].dropna().astype(int)]) or None
            last = max([last, *pdf["at_ms"].dropna().astype(int)])
            self.times.update((done, last))
            self._wait(done or last + self.timeout)
            self.events.appendList([(None if pd.isna(r.seq) else int(r.seq), float(r.t), r.event, r.data) for r in pdf.itertuples()])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.times.exists():
            yield self._given_out(key, int(timerValues.getCurrentWatermarkInMs()))
        elif self.closed.exists():
            self.closed.clear()

    def _wait(self, until: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(until)

    def _given_out(self, key: tuple, watermark: int) -> pd.DataFrame:
        found = sorted(self.events.get(), key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        self.events.clear()
        self.times.clear()
        self.closed.update((watermark,))
        self._wait(watermark + self.timeout)
        return pd.DataFrame({self.key: [key[0]], "events": [[dict(zip(("seq", "t", "event", "data"), e, strict=True)) for e in found]]})


def rollup_stream(events: DataFrame, late: str = "10 minutes", timeout: float = 600.0, key: str = "request_id", at: str = "ts") -> DataFrame:
    """The requests of a stream of events(request_id, seq, ts, event, data), each whole and once, with all that
    telemetry.request_rollup() gives.

    A request is emitted when the watermark has passed its done event, so events that come out of order, `late` at most, are
    in it, wherever spans of time begin; or `timeout` seconds after its last event, if it is never done. Events of a request
    that was given out are ignored for another timeout."""
    _use_rocksdb(events.sparkSession)
    has = lambda c, kind: F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    stamped = events.select(key, F.col(at).cast("timestamp").alias("at_time"), has("seq", "bigint").alias("seq"), seconds_of(at).alias("t"), "event", has("data", "string").alias("data")).withColumn("at_ms", F.unix_millis("at_time"))
    whole = stamped.withWatermark("at_time", late).groupBy(key).transformWithStateInPandas(_Requests(key, int(timeout * 1000)), f"{key} {dict(events.dtypes)[key]}, events array<struct<seq: bigint, t: double, event: string, data: string>>", "append", "EventTime")
    return whole.select(key, *request_columns(F.col("events")))
