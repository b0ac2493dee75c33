"""Streaming forms against their batch twins."""

import pytest
from pyspark.sql import functions as F

from vellumspark.sources import adapters as A
from vellumspark.streaming import jobs as R


@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    A.requests(spark, sf).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    return path


def drain(spark, stream, mode, tmp_path):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def read(spark, source):
    batch = spark.read.parquet(source)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(source)


def test_latest_snapshot(spark, source, tmp_path):
    batch, stream = read(spark, source)
    got = {r.key: (r.event_type, r.value) for r in drain(spark, R.latest_snapshot(stream), "complete", tmp_path).collect()}
    assert got == {r.key: (r.event_type, r.value) for r in R.latest_snapshot(batch).collect()}


def test_coalesce_changes(spark, source, tmp_path):
    batch, stream = read(spark, source)
    got = {(r.window, r.key) for r in drain(spark, R.coalesce_changes(stream), "append", tmp_path).collect()}
    assert got == {(r.window, r.key) for r in R.coalesce_changes(batch).collect()}


def test_consume_changes(spark, source, tmp_path):
    batch, stream = read(spark, source)
    seen, ticks = set(), []
    q = R.consume_changes(stream, "key", lambda df, i: (ticks.append(i), seen.update(r.key for r in df.collect())), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert seen == {r.key for r in batch.select("key").distinct().collect()} and len(ticks) >= 1


def test_admission_counts_only_admitted_requests(spark, sf):
    rows = R.admit_under_quota(A.requests(spark, sf), 2, 4).collect()
    times = {r.event_id: r.t for r in A.requests(spark, sf).select("event_id", F.unix_micros("ts").alias("t")).collect()}
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append((times[r.event_id], r.event_id, r.admitted))
    for events in by_key.values():
        starts = []
        for t, _, ok in sorted(events):
            assert ok == R.admit(starts, t, 2, 4)


def test_quota_clock():
    starts = []
    assert [R.admit(starts, s * 1_000_000, 2, 3) for s in (0, 1, 2, 61, 62, 86_400)] == [True, True, False, True, False, True]


def test_admission_stream(spark, source, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch, stream = read(spark, source)
    got = {r.event_id: r.admitted for r in drain(spark, R.admit_under_quota(stream, 2, 4), "append", tmp_path).collect()}
    assert got == {r.event_id: r.admitted for r in R.admit_under_quota(batch, 2, 4).collect()}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_expired_changes_are_those_the_batch_leaves_out(spark, source, rocks, tmp_path):
    batch, stream = read(spark, source)
    gone = [r.event_id for r in drain(spark, R.expire_changes(stream, "6 hours"), "append", tmp_path).collect()]
    live = {r.event_id for r in R.expire_changes(batch, "6 hours").collect()}
    assert len(gone) == len(set(gone)) and set(gone) == {r.event_id for r in batch.collect()} - live and gone and live


def test_rolling_quota_stream(spark, source, rocks, tmp_path):
    batch, stream = read(spark, source)
    key = lambda r: (r.event_id, r.key, r.in_minute, r.in_day, r.reason, r.wait_ms)
    assert sorted(map(key, drain(spark, R.rolling_quota(stream, 2, 4), "append", tmp_path).collect()), key=str) == sorted(map(key, R.rolling_quota(batch, 2, 4).collect()), key=str)


def test_expired_leases(spark, source, rocks, tmp_path):
    batch, stream = read(spark, source)
    seen = [(r.key, r["last"]) for r in drain(spark, R.expire_leases(stream, "6 hours"), "append", tmp_path).collect()]
    final = {r.key: r.last for r in batch.groupBy("key").agg(F.max("ts").alias("last")).collect()}
    want = {(r.key, r["last"]) for r in R.expire_leases(batch, "6 hours").collect()}
    # Items leased anew were reported before; what was reported with their last heartbeat is what the batch says.
    assert {x for x in seen if final[x[0]] == x[1]} == want


def test_answers_end_once(spark, rocks, tmp_path):
    rows = [(1, 0, "delta", "a "), (1, 1, "delta", "[P1] b"), (1, 2, "done", None), (1, 3, "delta", "late"), (2, 0, "delta", "x [P1]"), (2, 1, "error", None), (3, 0, "delta", "open"), (4, 0, "done", None)]
    frame = spark.createDataFrame(rows, "session long, seq int, type string, text string")
    path = str(tmp_path / "in")
    frame.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 3).parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.session, r.answer, r.ok) for r in drain(spark, R.assemble_answers(stream), "append", tmp_path).collect()}
    assert got == {(1, "a [P1] b", True), (2, "x [P1]", False), (4, "", True)}
    labels = spark.createDataFrame([(1, "P1", 7), (2, "P1", 7)], "session long, label string, segment_id int")
    cited = R.with_citations(R.assemble_answers(frame), labels).collect()
    assert {r.session: [c.segment_id for c in r.citations] for r in cited} == {1: [7], 2: [], 3: [], 4: []}
