"""Ledger and redelivery: no event is lost by its time, none is settled twice, the tenth failure is a dead letter."""

import json
import time

import pytest

from lorebase.streaming import ingest


def _put(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events) + "\n")


def _event(i, ts="2024-01-01T10:00:00"):
    return {"event_id": i, "session": "s", "content": f"fix the thing {i}", "ts": ts}


def test_late_events_stay_and_repeats_go(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    times = ("2024-01-01T10:00:00", "2024-01-01T01:00:00", "2024-01-01T02:00:00")
    for n, ts in enumerate(times):
        _put(source, f"{n}.txt", _event(f"e{n}", ts))
        ingest.ingest(spark, str(source), out, state, files=1).awaitTermination()
    # A repeat with a time two hours later, and one of the first, after all batches.
    _put(source, "3.txt", _event("e0", "2024-01-01T12:00:00"), _event("e1", times[1]), _event("e3", "2023-01-01T00:00:00"))
    ingest.ingest(spark, str(source), out, state).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/events").collect()) == ["e0", "e1", "e2", "e3"]


def test_failed_deliveries_come_again(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    counts = tmp_path / "counts"
    counts.mkdir()

    def handler(value: str) -> None:
        event = json.loads(value)["event_id"]
        with open(f"{counts}/{event}", "a") as f:
            f.write(".")
        times = len(open(f"{counts}/{event}").read())
        if event == "never" or (event == "third" and times < 3):
            raise ValueError(f"sink refused {event}")

    _put(source, "a.txt", _event("fine"), _event("third"), _event("never"), _event("fine"))
    query = ingest.deliver(spark, str(source), out, str(tmp_path / "state"), handler, unit_ms=1, every="50 milliseconds")
    read = lambda kind: spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{kind}").collect()
    try:
        end = time.time() + 240
        while not ((tmp_path / "out/dead").exists() and read("dead")):
            assert time.time() < end and query.exception() is None
            time.sleep(1)
        # What is settled is not delivered again.
        _put(source, "b.txt", _event("never"), _event("fine"), _event("later"))
        while "later" not in {r.event_id for r in read("accepted")}:
            assert time.time() < end and query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
    assert {(r.event_id, r.delivered) for r in read("accepted")} == {("fine", 1), ("third", 3), ("later", 1)}
    (dead,) = read("dead")
    assert (dead.event_id, dead.delivered, dead.reason, dead.subject) == ("never", 10, "sink refused never", "memory.capture")
    assert json.loads(dead.payload)["event_id"] == "never"
    retries = {(r.event_id, r.delivered) for r in read("retries")}
    assert retries == {("third", 1), ("third", 2), *(("never", n) for n in range(1, 10))}


@pytest.mark.parametrize("delivered, wait", [(1, 2), (3, 8), (8, 256), (9, 256), (10, None)])
def test_waits(spark, delivered, wait):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*ingest.redelivery(F.lit(delivered), F.lit(1000).cast("long"))).first()
    assert (row.next_try, row.dead) == (None if wait is None else 1000 + wait, wait is None)
