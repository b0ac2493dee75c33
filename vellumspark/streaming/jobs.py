"""Streaming jobs with batch twins. The same function takes a batch or a streaming frame where both can run it.

Late rows: streams drop what comes over ten minutes late (WATERMARK).
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from vellumspark.operators.joins import resolve_citations

WATERMARK = "10 minutes"
MINUTE, DAY, LATENESS = 60_000_000, 86_400_000_000, 600_000_000


def micros(c):
    return F.unix_micros(c)


def consume_changes(stream: DataFrame, book: str, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs the handler once a micro-batch with the distinct books that changed; change_feed gives 500 changes a batch."""
    return stream.writeStream.foreachBatch(lambda df, i: handler(df.select(book).distinct(), i)).option("checkpointLocation", checkpoint)


def change_feed(spark: SparkSession, path: str, id_col: str = "id", after: int = 0, limit: int = 500) -> DataFrame:
    """A stream of the rows of a growing Parquet folder in the order of their ids: a batch is the next `limit` rows after the last id seen.

    The offset is that id, so a query that starts again from its checkpoint goes on with exactly the next rows, and one that
    starts anew begins after `after`. Ids only grow. The rows of a batch, `limit` at most, pass through the driver, which reads
    the folder with pyarrow: a path of the local or another file system that it knows.
    """
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    # Classes made here travel to workers by value: they need no import of this library there.
    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, schema, options):
            self.names, self.options = schema.names, options

        def rows(self, after, until=None, most=None):
            import pyarrow as pa
            import pyarrow.compute as pc
            import pyarrow.dataset as ds

            key = pc.field(self.options["id"])
            wanted = key > after if until is None else (key > after) & (key <= until)
            path = self.options["path"]
            data = ds.dataset(path.removeprefix("file:") if path.startswith("file:") else path, format="parquet", exclude_invalid_files=True)
            kept = None
            for batch in data.to_batches(columns=self.names, filter=wanted):
                # No more than `most` rows and one batch are held.
                kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
                kept = kept.sort_by(self.options["id"])[:most] if most else kept.sort_by(self.options["id"])
            return [] if kept is None else list(zip(*(kept[c].to_pylist() for c in self.names)))

        def initialOffset(self):
            return {"last": int(self.options["after"])}

        def read(self, start):
            rows = self.rows(start["last"], most=int(self.options["limit"]))
            at = self.names.index(self.options["id"])
            return iter(rows), {"last": rows[-1][at] if rows else start["last"]}

        def readBetweenOffsets(self, start, end):
            return iter(self.rows(start["last"], end["last"]))

    class Feed(DataSource):
        @classmethod
        def name(cls):
            return "change_feed"

        def schema(self):
            return self.options["fields"]

        def simpleStreamReader(self, schema):
            return Reader(schema, self.options)

    spark.dataSource.register(Feed)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    return spark.readStream.format("change_feed").options(id=id_col, after=str(after), limit=str(limit), fields=fields).load(path)


def change_ticks(changes: DataFrame, id_col: str = "id", after: int = 0, limit: int = 500, first: int = 0) -> DataFrame:
    """Changes with ids above `after` and the tick each belongs to, from `first` on: `limit` of them a tick, in order of their ids.

    The batch twin of change_feed for a feed that is far behind: places are counted by ranges of ids, in tasks, so a backlog
    of any length takes one micro-batch, not one a tick, and no row passes through the driver.
    """
    from vellumspark.operators.windows import numbered

    placed = numbered(changes.where(F.col(id_col) > after), [id_col])
    return placed.withColumn("tick", F.floor((F.col("place") - 1) / limit).cast("long") + F.lit(first)).drop("place")


class _Expiry(StatefulProcessor):
    """Keeps the changes of a key until a timer at their age, and then reports them."""

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "t long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            for event, t in zip(df["event_id"].tolist(), df["t"].tolist()):
                self.live.appendValue((t, event))
                self.handle.registerTimer(-(-t // 1000) + self.age_ms)
        yield pd.DataFrame({"key": [], "event_id": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = (expiredTimerInfo.getExpiryTimeInMs() - self.age_ms) * 1000
        every = list(self.live.get())
        gone, live = [r for r in every if r[0] <= until], [r for r in every if r[0] > until]
        self.live.put(live) if live else self.live.clear()
        yield pd.DataFrame({"key": [key[0]] * len(gone), "event_id": [r[1] for r in gone]}).astype("int64")

    def close(self) -> None:
        pass


def _seconds(age: str) -> int:
    n, unit = age.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def expire_changes(changes: DataFrame, age: str = "1 day") -> DataFrame:
    """As a batch, changes younger than `age` before the newest one. As a stream, those that have just passed that age.

    A stream holds live changes in state until event time has moved past their age, reports them (key, event_id) and
    forgets them; so what it has not reported is what the batch returns. It takes no lateness: older rows are dropped.
    """
    if changes.isStreaming:
        t = changes.withWatermark("ts", "0 seconds").select("key", "event_id", micros(F.col("ts")).alias("t"), "ts")
        return t.groupBy("key").transformWithStateInPandas(_Expiry(1000 * _seconds(age)), "key long, event_id long", "append", "EventTime")
    newest = changes.agg(F.max("ts").alias("newest"))
    return changes.join(F.broadcast(newest)).where(F.col("ts") > F.col("newest") - F.expr(f"INTERVAL {age}")).drop("newest")


class _LastDay(StatefulProcessor):
    """State of a key that ends a day after its newest request: one timer a key, set anew with every request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def keep(self, times: list[int], newest: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(newest // 1000 + DAY // 1000 + 1)
        self.times.put([(x,) for x in times]) if times else self.times.clear()

    def ended(self) -> None:
        self.times.clear()

    def close(self) -> None:
        pass


class _Rolling(_LastDay):
    """Keeps the times of a key's requests of the last day, in order."""

    def __init__(self, rpm: int, rpd: int):
        self.rpm, self.rpd = rpm, rpd

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, out = [r[0] for r in self.times.get()], []
        for df in sorted_frames(rows):
            for event, t in zip(df["event_id"].tolist(), df["t"].tolist()):
                insort(times, t)
                day, minute = (len(times) - bisect_right(times, t - x) for x in (DAY, MINUTE))
                reason, wait = None, 0
                if day >= self.rpd:
                    reason, wait = "rpd", times[-self.rpd] + DAY - t
                elif minute >= self.rpm:
                    reason, wait = "rpm", times[-self.rpm] + MINUTE - t
                out.append((event, key[0], minute, day, reason, max(wait // 1000, 0)))
        if out:
            # A row within the watermark may still ask for the day before it.
            self.keep(times[bisect_right(times, times[-1] - DAY - LATENESS) :], times[-1])
        yield pd.DataFrame(out, columns=["event_id", "key", "in_minute", "in_day", "reason", "wait_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ended()
        yield pd.DataFrame({c: [] for c in ("event_id", "key", "in_minute", "in_day", "reason", "wait_ms")}).astype({"event_id": "int64", "key": "int64", "in_minute": "int64", "in_day": "int64", "reason": "object", "wait_ms": "int64"})


def rolling_quota(requests: DataFrame, rpm: int, rpd: int) -> DataFrame:
    """Requests of the last minute and day up to each request of a key, the wait in ms and its reason.

    Windows are half open, (t - w, t]. The wait lasts until the request `limit` places back leaves its window. As a stream,
    the state of a key is the times of its last day, which a timer ends a day after the newest, and requests count in the order they come.
    """
    if requests.isStreaming:
        t = requests.withWatermark("ts", WATERMARK).select("key", "event_id", micros(F.col("ts")).alias("t"), "ts")
        return t.groupBy("key").transformWithStateInPandas(_Rolling(rpm, rpd), "event_id long, key long, in_minute long, in_day long, reason string, wait_ms long", "append", "EventTime")
    t = requests.withColumn("t", micros(F.col("ts")))
    w = Window.partitionBy("key").orderBy("t")
    day, minute = w.rangeBetween(-(DAY - 1), 0), w.rangeBetween(-(MINUTE - 1), 0)
    rows = Window.partitionBy("key").orderBy("t", "event_id")
    n_day, n_minute = F.count("*").over(day), F.count("*").over(minute)
    c = t.withColumns({"in_minute": n_minute, "in_day": n_day, "back_day": F.lag("t", rpd - 1).over(rows), "back_minute": F.lag("t", rpm - 1).over(rows)})
    reason = F.when(F.col("in_day") >= rpd, "rpd").when(F.col("in_minute") >= rpm, "rpm")
    wait = F.when(F.col("in_day") >= rpd, F.col("back_day") + DAY - F.col("t")).when(F.col("in_minute") >= rpm, F.col("back_minute") + MINUTE - F.col("t")).otherwise(F.lit(0))
    return c.select("event_id", "key", "in_minute", "in_day", reason.alias("reason"), F.greatest(F.floor(F.coalesce(wait, F.lit(0)) / 1000), F.lit(0)).alias("wait_ms"))


class _Admission(_LastDay):
    """Keeps the start times of admitted requests of a key, at most the daily limit of them."""

    def __init__(self, rpm: int, rpd: int):
        self.rpm, self.rpd = rpm, rpd

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = deque(r[0] for r in self.times.get())
        out, newest = [], None
        for df in sorted_frames(rows):
            for event, t in zip(df["event_id"], df["t"]):
                ok = admit(starts, int(t), self.rpm, self.rpd)
                out.append((key[0], event, ok))
                newest = int(t)
        if newest is not None:
            self.keep(list(starts), newest)
        yield pd.DataFrame(out, columns=["key", "event_id", "admitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ended()
        yield pd.DataFrame({"key": [], "event_id": [], "admitted": []}).astype({"key": "int64", "event_id": "int64", "admitted": "bool"})


def sorted_frames(rows: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    every = list(rows)
    return [pd.concat(every).sort_values(["t", "event_id"])] if every else []


def admit(starts: deque[int] | list[int], t: int, rpm: int, rpd: int) -> bool:
    """Whether a request may start now; admitted ones are noted, and those over a day old forgotten."""
    while starts and starts[0] <= t - DAY:
        del starts[0]
    ok = len(starts) < rpd and (len(starts) < rpm or starts[-rpm] <= t - MINUTE)
    if ok:
        starts.append(t)
    return ok


def admit_under_quota(requests: DataFrame, rpm: int, rpd: int) -> DataFrame:
    """Admission by key in time order where only admitted requests count: key, event_id, admitted.

    As a stream the state is the admitted starts of a key, at most rpd numbers, which a timer ends a day after the newest
    request. As a batch, one key's requests pass through
    one task in sorted chunks of a sorted partition, so that a key of any size needs only that state in memory.
    """
    schema = "key long, event_id long, admitted boolean"
    if requests.isStreaming:
        timed = requests.withWatermark("ts", WATERMARK).select("key", "event_id", micros(F.col("ts")).alias("t"), "ts")
        return timed.groupBy("key").transformWithStateInPandas(_Admission(rpm, rpd), schema, "append", "EventTime")
    t = requests.select("key", "event_id", micros(F.col("ts")).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, starts = None, deque()
        for df in frames:
            ok = []
            for k, x in zip(df["key"], df["t"]):
                if k != key:
                    key, starts = k, deque()
                ok.append(admit(starts, int(x), rpm, rpd))
            yield df[["key", "event_id"]].assign(admitted=ok)

    return t.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, schema)


def failed_login_limit(attempts: DataFrame, limit: int = 10, minutes: int = 10) -> DataFrame:
    """Addresses with at least `limit` failures in the minutes up to an attempt; as a stream in windows a minute apart."""
    if attempts.isStreaming:
        g = attempts.withWatermark("ts", WATERMARK).groupBy("key", F.window("ts", f"{minutes} minutes", "1 minute")).agg(F.count("*").alias("failures"))
        return g.where(F.col("failures") >= limit)
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-(minutes * MINUTE - 1), 0)
    return attempts.withColumn("t", micros(F.col("ts"))).withColumn("failures", F.count("*").over(w)).where(F.col("failures") >= limit).drop("t")


class _Lease(StatefulProcessor):
    """Keeps a key's last heartbeat, and one timer at its end."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(df["t"].max()) for df in rows)
        if not self.last.exists() or newest > self.last.get()[0]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.last.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.ttl_ms + 1)
        yield pd.DataFrame({"key": [], "t": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "t": [last]}).astype("int64")

    def close(self) -> None:
        pass


def expire_leases(beats: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Items whose last heartbeat is older than the limit before the newest of all: key, last.

    As a stream, an item is reported when event time passes the end of its lease; a later heartbeat leases it anew.
    """
    if beats.isStreaming:
        t = beats.withWatermark("ts", "0 seconds").select("key", micros(F.col("ts")).alias("t"), "ts")
        out = t.groupBy("key").transformWithStateInPandas(_Lease(1000 * _seconds(ttl)), "key long, t long", "append", "EventTime")
        return out.select("key", F.timestamp_micros("t").alias("last"))
    last = beats.groupBy("key").agg(F.max("ts").alias("last"))
    now = beats.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now)).where(F.col("last") < F.col("now") - F.expr(f"INTERVAL {ttl}")).drop("now")


class _Timeouts(StatefulProcessor):
    """Passes a session's events on until it ends or waits too long; keeps its last time, whether a delta came, and its end."""

    def __init__(self, first_us: int, idle_us: int, keep_us: int):
        self.first_us, self.idle_us, self.keep_us = first_us, idle_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "t long, seq long, streaming boolean, ended boolean")

    def limit(self, streaming: bool) -> int:
        return self.idle_us if streaming else self.first_us

    def set(self, t: int, seq: int, streaming: bool, ended: bool) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.state.update((t, seq, streaming, ended))
        self.handle.registerTimer((t + (self.keep_us if ended else self.limit(streaming))) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, every = [], list(rows)
        t, seq, streaming, ended = self.state.get() if self.state.exists() else (None, None, False, False)
        if not ended and every:
            frame = pd.concat(every).sort_values(["t", "seq"])
            for now, at, kind, text in frame[["t", "seq", "type", "text"]].itertuples(index=False):
                if t is not None and now - t > self.limit(streaming):
                    t, ended = t + self.limit(streaming), True
                    out.append((key[0], seq + 1, t, "error", None, "TIMEOUT"))
                    break
                t, seq, streaming = int(now), int(at), streaming or kind == "delta"
                if kind != "start":
                    out.append((key[0], seq, t, kind, text, None))
                if kind in ("done", "error"):
                    ended = True
                    break
            self.set(t, seq, streaming, ended)
        yield pd.DataFrame(out, columns=TIMED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, seq, streaming, ended = self.state.get()
        if ended:
            self.state.clear()
            yield pd.DataFrame([], columns=TIMED)
        else:
            end = t + self.limit(streaming)
            self.set(end, seq + 1, streaming, True)
            yield pd.DataFrame([(key[0], seq + 1, end, "error", None, "TIMEOUT")], columns=TIMED)

    def close(self) -> None:
        pass


TIMED = ["session", "seq", "t", "type", "text", "code"]


def with_timeouts(events: DataFrame, first: int = 30, idle: int = 45, keep: str = "1 day") -> DataFrame:
    """Events of sessions with an error row of code TIMEOUT where one waits too long: session, seq, t (microseconds), type, text, code.

    events hold session, seq, ts, type (start, delta, done, error) and text. Until the first delta a session may wait `first`
    seconds for its next event, then `idle` seconds. What came before a timeout stays, nothing follows it, a done or an
    error; start rows set the clock and are not passed on. A session that is still open times out when the newest time of all
    has passed its limit. As a stream, event time is what passes; the mark that a session has ended is kept for `keep`.
    """
    first_us, idle_us = first * 1_000_000, idle * 1_000_000
    if events.isStreaming:
        t = events.withWatermark("ts", "0 seconds").select("session", "seq", micros(F.col("ts")).alias("t"), "type", "text", "ts")
        return t.groupBy("session").transformWithStateInPandas(_Timeouts(first_us, idle_us, 1_000_000 * _seconds(keep)), "session long, seq long, t long, type string, text string, code string", "append", "EventTime")
    w = Window.partitionBy("session").orderBy("t", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = events.select("session", F.col("seq").cast("long").alias("seq"), micros(F.col("ts")).alias("t"), "type", "text")
    streaming = F.coalesce(F.bool_or(F.col("type") == "delta").over(before), F.lit(False))
    e = e.withColumns({"_last": F.lag("t").over(w), "_seq": F.lag("seq").over(w), "_limit": F.when(streaming, idle_us).otherwise(first_us)})
    e = e.withColumn("_late", F.coalesce(F.col("t") - F.col("_last") > F.col("_limit"), F.lit(False)))
    ends = F.col("_late") | F.col("type").isin("done", "error")
    e = e.withColumn("_over", F.coalesce(F.bool_or(ends).over(before), F.lit(False))).where("not _over")
    timeout = (F.lit("error").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("TIMEOUT").alias("code"))
    passed = e.where("not _late and type <> 'start'").select("session", "seq", "t", "type", "text", F.lit(None).cast("string").alias("code"))
    late = e.where("_late").select("session", (F.col("_seq") + 1).alias("seq"), (F.col("_last") + F.col("_limit")).alias("t"), *timeout)
    now = events.agg(F.max(micros(F.col("ts"))).alias("now"))
    open_ = e.groupBy("session").agg(F.max_by(F.struct("t", "seq"), F.struct("t", "seq")).alias("last"), F.bool_or(ends).alias("ended"), F.bool_or(F.col("type") == "delta").alias("delta"))
    open_ = open_.where("not ended").join(F.broadcast(now)).withColumn("end", F.col("last.t") + F.when(F.col("delta"), idle_us).otherwise(first_us)).where("now > end")
    return passed.unionByName(late).unionByName(open_.select("session", (F.col("last.seq") + 1).alias("seq"), F.col("end").alias("t"), *timeout))


def stream_gaps(events: DataFrame, idle: int = 45) -> DataFrame:
    """Sessions of a key cut where it is idle for over `idle` seconds: key, started, last, n."""
    if events.isStreaming:
        g = events.withWatermark("ts", WATERMARK).groupBy("key", F.session_window("ts", f"{idle} seconds")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n"))
        return g.select("key", "started", "last", "n")
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    new = F.coalesce(micros(F.col("ts")) - micros(F.lag("ts").over(w)) >= idle * 1_000_000, F.lit(True))
    s = events.withColumn("_s", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("key", "_s").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("_s")


def coalesce_changes(events: DataFrame, flush: str = "1 minute") -> DataFrame:
    """Distinct change keys of every flush window."""
    e = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    return e.withColumn("window", F.window("ts", flush)["start"]).select("window", "key").dropDuplicates(["window", "key"])


def incremental_index(postings: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings with those of changed texts replaced by the fresh ones; a changed text without fresh ones leaves."""
    return postings.join(changed.select("seg_id").distinct(), "seg_id", "left_anti").unionByName(fresh)


def latest_snapshot(events: DataFrame) -> DataFrame:
    """Current state of every key."""
    return events.groupBy("key").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("s")).select("key", "s.event_type", "s.value")


def import_once(results: DataFrame, key: str, imported: DataFrame | None = None) -> DataFrame:
    """Results not imported before, each once; as a stream within the watermark."""
    if results.isStreaming:
        return results.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])
    r = results.join(imported.select(key), key, "left_anti") if imported is not None else results
    return r.dropDuplicates([key])


class _Answer(StatefulProcessor):
    """Keeps the text of a session until its first done or error, and that it has ended; with times, for a while after its last row."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.text = handle.getListState("text", "part string")
        self.ended = handle.getValueState("ended", "ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, every = [], list(rows)
        if every and self.keep_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(max(df["t"].max() for df in every)) // 1000 + self.keep_ms + 1)
        if not self.ended.exists() and every:
            for kind, text in pd.concat(every).sort_values("seq")[["type", "text"]].itertuples(index=False):
                if kind == "delta":
                    self.text.appendValue((text,))
                elif kind in ("done", "error"):
                    out.append((key[0], "".join(r[0] for r in self.text.get()) if self.text.exists() else "", kind == "done"))
                    self.text.clear()
                    self.ended.update((kind == "done",))
                    break
        yield pd.DataFrame(out, columns=["session", "answer", "ok"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.text.clear()
        self.ended.clear()
        yield pd.DataFrame({"session": [], "answer": [], "ok": []}).astype({"session": "int64", "answer": "object", "ok": "bool"})

    def close(self) -> None:
        pass


def assemble_answers(deltas: DataFrame, keep: str = "1 day") -> DataFrame:
    """Text of every session up to its first done or error, and whether it may carry citations: session, answer, ok.

    As a stream, an answer comes when its session ends; what comes after is dropped. Deltas come in order between batches.
    Where deltas have a time (ts), a session's state ends `keep` after its last row, which a timer sees to; without one it stays.
    """
    if deltas.isStreaming:
        schema = "session long, answer string, ok boolean"
        if "ts" not in deltas.columns:
            return deltas.select("session", "seq", "type", "text").groupBy("session").transformWithStateInPandas(_Answer(None), schema, "append", "None")
        timed = deltas.withWatermark("ts", WATERMARK).select("session", "seq", "type", "text", micros(F.col("ts")).alias("t"), "ts")
        return timed.groupBy("session").transformWithStateInPandas(_Answer(1000 * _seconds(keep)), schema, "append", "EventTime")
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("type").isin("done", "error").cast("int")).over(w), F.lit(0))
    kept = deltas.withColumn("_e", ended).where("_e = 0")
    parts = F.sort_array(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text"))))
    return kept.groupBy("session").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("answer"), F.bool_or(F.col("type") == "done").alias("ok"))


def with_citations(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers with the segments they cite, in order of first mention; one that ended in an error cites nothing.

    labels hold session, label and segment_id.
    """
    cited = resolve_citations(answers.where("ok"), labels, ["session"]).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("position", "label", "segment_id"))).alias("citations"))
    none = F.array().cast(cited.schema["citations"].dataType)
    return answers.join(cited, "session", "left").withColumn("citations", F.coalesce("citations", none))


def throttle_progress(events: DataFrame, every: str = "2 seconds") -> DataFrame:
    """The last heartbeat of a key in every window."""
    e = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    g = e.groupBy("key", F.window("ts", every).alias("w")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return g.select("key", "event_id")
