"""Streams: windows and late rows, feedback with state, paged services."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import feedback
from tallyloom.plans import extended
from tallyloom.streaming import feedback_stream, incremental, pages

T0 = datetime(2026, 1, 1)


def put(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")


def run(spark, folder, schema, work, mode="append"):
    """Take what is new, one file at a time, in the order of names."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = work(stream)
    out.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


ROWS = "ts timestamp, k string, v double"


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    hour = lambda h, k="a": (T0 + timedelta(hours=h), k, 1.0)
    work = lambda s: incremental.windowed_counts(s, "ts", "1 hour", "2 hours", ["k"], "v")
    put(spark, tmp_path, "1", [hour(0), hour(0.5), hour(5)], ROWS)
    run(spark, tmp_path, ROWS, work)
    put(spark, tmp_path, "2", [hour(4), hour(0.2), hour(3.5, "b")], ROWS)  # 0.2 is later than two hours behind 5
    run(spark, tmp_path, ROWS, work)
    put(spark, tmp_path, "3", [hour(100)], ROWS)
    got = {((r["window_start"] - T0).total_seconds() / 3600, r["k"]): (r["n"], r["total"]) for r in run(spark, tmp_path, ROWS, work)}
    assert got == {(0, "a"): (2, 2.0), (3, "b"): (1, 1.0), (4, "a"): (1, 1.0), (5, "a"): (1, 1.0)}


def test_sessions_and_first_sights_over_restarts(spark, tmp_path):
    minute = lambda m, k="a": (T0 + timedelta(minutes=m), k, 1.0)
    one, two = tmp_path / "s", tmp_path / "f"
    for folder, work in ((one, lambda s: incremental.sessions(s, "ts", "30 minutes", "1 hour", "k")), (two, lambda s: incremental.first_seen(s, "ts", "1 hour", ["k"]))):
        put(spark, folder, "1", [minute(0), minute(20), minute(10, "b")], ROWS)
        run(spark, folder, ROWS, work)
        put(spark, folder, "2", [minute(45), minute(100), minute(30, "b")], ROWS)
        run(spark, folder, ROWS, work)
        put(spark, folder, "3", [minute(9000, "end")], ROWS)
        got = run(spark, folder, ROWS, work)
        if folder == one:
            assert {(r["k"], (r["session_start"] - T0).seconds // 60, r["n"]) for r in got} == {("a", 0, 3), ("a", 100, 1), ("b", 10, 2)}
        else:
            assert sorted(r["k"] for r in got) == ["a", "b", "end"]


LINKS = "link_id string, source_id string, source_type string, target_type string, is_current boolean, created_at timestamp"
NOTES = "link_id string, signal string, created_at timestamp"


def test_feedback_with_state_over_a_restart(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    links = [(f"L{i}", f"s{i}", "transaction", "email", i != 3, at(i)) for i in range(6)]
    notes = [("L0", "rejected", at(6)), ("L1", "confirmed", at(6)), ("L3", "rejected", at(7)), ("L0", "rejected", at(8)), ("L4", "flagged", at(8)), ("L5", "rejected", at(1)), ("gone", "rejected", at(2)), (None, "rejected", at(2))]
    make = lambda a, b: feedback_stream.events(spark.createDataFrame(a, LINKS), spark.createDataFrame(b, NOTES))
    for k, (a, b) in enumerate([(links[:5], notes[5:]), (links[5:], notes[:2]), ([], notes[2:5])]):
        make(a, b).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = run(spark, tmp_path, feedback_stream.INPUT, feedback_stream.actions)
    assert sum(r["action"] == "handled" for r in got) == 7 and sum(r["action"] == "unknown" for r in got) == 0
    make([("end", "x", "transaction", "email", True, at(24 * 400))], []).write.parquet(f"{tmp_path}/in/9")
    got = run(spark, tmp_path, feedback_stream.INPUT, feedback_stream.actions)
    make([("end2", "x", "transaction", "email", True, at(24 * 500))], []).write.parquet(f"{tmp_path}/in/99")
    got = run(spark, tmp_path, feedback_stream.INPUT, feedback_stream.actions)
    assert [r["link_id"] for r in got if r["action"] == "unknown"] == ["gone"]
    closed = {(r["link_id"], r["entity_id"]) for r in got if r["action"] == "closed"}
    full = spark.createDataFrame(links, LINKS).withColumns({"target_id": F.lit("t"), "effective_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string")})
    empty = spark.createDataFrame([], "entity_id string, entity_type string, target_type string, reason_code string, run_id string, created_at timestamp")
    done = feedback.process(full, empty, spark.createDataFrame(notes, NOTES).withColumn("processed", F.lit(False)), F.lit(T0))
    assert closed == {("L0", "s0"), ("L5", "s5")}
    assert {c[1] for c in closed} == {r["entity_id"] for r in done.unmatched.collect()}
    assert {r["link_id"] for r in done.links.where("NOT is_current").collect()} == {c[0] for c in closed} | {"L3"}


class _State:
    """A value or map of one slot that counts its calls."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*a):
            _State.calls += 1
            if name in ("exists", "get", "getValue"):
                return bool(self.held) if name == "exists" else self.held.get(a[0] if a else None)
            if name in ("update", "updateValue"):
                self.held[a[0] if name == "updateValue" else None] = a[-1]
            else:
                self.held.pop(a[0] if a else None, None)

        return call


class _Slot:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _State())

    getMapState = getValueState

    def registerTimer(self, due):
        self.timers.append(due)


class _Now:
    def __init__(self, now=0, due=0):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: now, lambda: due


def test_calls_of_the_state_grow_with_slots_and_not_with_links():
    """1,000 links and notes of one slot in two batches: each reads and writes its state once."""
    work, slot, calls = feedback_stream.Feedback(1000), _Slot(), []
    work.init(slot)
    out = []
    for what in ("rejected", '["s","transaction",null]'):
        _State.calls = 0
        frames = [pd.DataFrame({"link_id": [f"L{i}" for i in range(k, k + 500)], "what": what, "ms": 5}) for k in (0, 500)]
        out += list(work.handleInputRows((1,), iter(frames), _Now()))
        calls.append(_State.calls)
    got = pd.concat(out)
    assert max(calls) <= 6
    assert got["action"].value_counts().to_dict() == {"handled": 1000, "closed": 1000} and slot.timers == [1005]
    assert set(map(tuple, got[got["action"] == "closed"][["entity_id", "entity_type", "target_type"]].values)) == {("s", "transaction", None)}


def test_what_waits_keeps_its_first_time():
    """Rows of one batch count by their latest time, later batches leave it; what is not due yet stays and is timed anew."""
    work, slot = feedback_stream.Feedback(1000), _Slot()
    work.init(slot)
    give = lambda *rows, now=0: list(work.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["link_id", "what", "ms"])]), _Now(now)))
    give(("a", "noted", 5), ("a", "rejected", 9), ("a", "noted", 7))
    give(("a", "noted", 800), ("b", "rejected", 2000))
    assert slot.timers == [1009]
    assert list(work.handleExpiredTimer((1,), _Now(1009), _Now(due=1008))) == []
    (out,) = work.handleExpiredTimer((1,), _Now(1010), _Now(due=1009))
    assert out["link_id"].tolist() == ["a"] and out["action"].tolist() == ["unknown"] and slot.timers == [1009, 3000]
    closed = [tuple(r) for f in give(("a", '["x","t","e"]', 1), ("b", '["y","t","e"]', 1), ("b", '["z","t","e"]', 1)) for r in f.values]
    assert closed == [("b", "closed", "y", "t", "e")]
    assert give(("b", "rejected", 1), ("c", "shut", 1), ("c", "rejected", 1))[0]["action"].tolist() == ["handled", "handled"]


def test_odd_rows_of_links_and_feedback(spark, tmp_path):
    """Parts that are null, quotes, and times that pandas cannot hold."""
    far = "CAST('9000-01-01' AS timestamp)"
    rows = spark.sql(f"""SELECT * FROM VALUES ('q"', 'link', {far}, 's"\\\\', CAST(NULL AS string), 't', true, CAST(NULL AS string)), ('q"', 'feedback', {far}, NULL, NULL, NULL, NULL, 'rejected'),
        ('n', 'link', NULL, 's', 'x', 't', NULL, NULL), ('n', 'feedback', CAST('0200-01-01' AS timestamp), NULL, NULL, NULL, NULL, 'rejected'), ('m', 'feedback', NULL, NULL, NULL, NULL, NULL, NULL) AS t({", ".join(c.split()[0] for c in feedback_stream.INPUT.split(", "))})""")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    got = sorted((tuple(r) for r in run(spark, tmp_path, feedback_stream.INPUT, feedback_stream.actions)), key=str)
    assert [r for r in got if r[1] == "closed"] == [('q"', "closed", 's"\\', None, "t")]
    assert sorted(r[0] for r in got if r[1] == "handled") == ["m", 'q"']  # what is older than the first watermark is late


def test_rows_of_one_time_are_dealt_to_several_files(spark):
    rows = spark.range(4000).selectExpr("id", "TIMESTAMP'2024-01-01' AS at")
    out = extended._streamed(spark, "", lambda s: s.select("id", "at", F.col("_metadata.file_path").alias("file")), "files", rows, "at").where("id IS NOT NULL")
    assert out.select("id").distinct().count() == out.count() == 4000
    assert max(r["count"] for r in out.groupBy("file").count().collect()) <= 2000


@pytest.mark.parametrize(("most", "want"), [(None, 23), (5, 5)])
def test_pages_come_once_over_restarts(spark, tmp_path, most, want):
    """A service as files, which grows between the runs; ``max_pages`` holds over all runs."""
    service = tmp_path / "service"
    service.mkdir()

    def publish(first, stop, last=False):
        for k in range(first, stop):
            (service / f"p{k}").write_text(json.dumps({"rows": [] if k == 4 else [[k, i] for i in range(3)], "next": None if last and k == stop - 1 else f"p{k + 1}"}))

    def fetch(link, folder=str(service)):
        import json
        import os

        if not os.path.exists(f"{folder}/{link}"):  # not there yet
            return [], None
        page = json.loads(open(f"{folder}/{link}").read())
        there = page["next"] if page["next"] and os.path.exists(f"{folder}/{page['next']}") else None
        return [tuple(r) for r in page["rows"]], there

    publish(0, 23, last=True)

    def take(batches):
        stream = pages.stream_pages(spark, fetch, "p0", "page int, row int", most, batch=2)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            if batches is None:
                query.processAllAvailable()
            else:
                import time

                while (query.lastProgress or {"batchId": -1})["batchId"] < batches and query.isActive:
                    time.sleep(0.05)
        finally:
            query.stop()

    take(1)
    take(2)
    take(None)
    rows = sorted(map(tuple, spark.read.schema("page int, row int").parquet(f"{tmp_path}/out").collect()))
    assert rows == [(k, i) for k in range(want) if k != 4 for i in range(3)]
