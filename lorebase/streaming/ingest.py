"""Event ingestion with Structured Streaming: validation, de-duplication, dead letters, redelivery, session windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lorebase.functions.gates import rules

PAYLOAD = "event_id string, agent string, session string, turn long, content string, ts timestamp"
#: Characters of a content at most; fixed values: deliveries before an event is dead, and the longest wait in seconds.
MOST_CHARS, MOST_DELIVERIES, LONGEST_WAIT = 100_000, 10, 300
#: Files of one micro-batch, which bounds what is in flight.
BATCH_FILES = 64


def parse(lines: DataFrame) -> DataFrame:
    """value (a JSON line) -> fields, an id where the event brings none, and why it is refused (null if it is not)."""
    event = lines.select("value", F.from_json("value", PAYLOAD).alias("e")).select("value", "e.*")
    made = F.concat(F.lit("nats_"), F.sha2(F.concat_ws("|", F.coalesce("agent", F.lit("")), F.coalesce("session", F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")), "value"), 256))
    reason = (
        F.when(~F.coalesce(F.trim("value").rlike(r"^\{(?s:.*)\}$"), F.lit(False)), "payload must be an object")
        .when(F.coalesce(F.trim("content"), F.lit("")) == "", "content must be a non-empty string")
        .when(F.length("content") > MOST_CHARS, "content exceeds configured capture limit")
        .when(F.col("ts").isNull(), "ts must be a time")
    )
    return event.withColumn("event_id", F.coalesce("event_id", made)).withColumn("reason", reason)


def _lines(spark: SparkSession, source: str, files: int) -> DataFrame:
    return parse(spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = BATCH_FILES):
    """Read JSON lines and write the accepted events with their gate decision, exactly once per batch id.

    Each batch writes to a folder named after it and overwrites it when it is run again.  An event whose id was
    accepted before is dropped, however long ago that was; none is dropped for its time, however late it comes.  The ids seen
    are the ledger: keyed state without a watermark, which grows with the ids and stays on disk (RocksDB in ``session``).
    """
    events = _lines(spark, source, files).where("reason IS NULL").dropDuplicates(["event_id"])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("gate", rules(F.col("content"))).drop("reason").write.mode("overwrite").parquet(f"{sink}/events/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(spark: SparkSession, source: str, sink: str, checkpoint: str, subject: str = "memory.capture", files: int = BATCH_FILES):
    """Write an envelope (reason, subject, payload) for each line that is refused; a stream of its own, as bad lines have no time."""
    letters = _lines(spark, source, files).where("reason IS NOT NULL").select("reason", F.lit(subject).alias("subject"), F.col("value").alias("payload"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/dead/batch={number}")

    return letters.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redelivery(delivered: Column, at: Column) -> list[Column]:
    """next_try and dead of an event that failed at its n-th delivery: twice the wait each time, none after the tenth."""
    wait = F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.least(delivered, F.lit(8))).cast("long"))
    dead = delivered >= MOST_DELIVERIES
    return [F.when(~dead, at + wait).alias("next_try"), dead.alias("dead")]


OUTCOME = "event_id string, outcome string, delivered int, next_try long, value string, error string"
LEDGER = "status string, delivered int, due long, value string"


def _delivery(handler: Callable[[str], None], unit_ms: int):
    """One event's ledger entry: waiting with a timer, accepted, or dead."""

    def attempt(key, value: str, delivered: int, state) -> pd.DataFrame:
        delivered += 1
        now = state.getCurrentProcessingTimeMs()
        try:
            handler(value)
            outcome, due, error = "accepted", None, None
        except Exception as e:  # noqa: BLE001  whatever the handler raises is a failed delivery
            wait = min(LONGEST_WAIT, 2 ** min(delivered, 8)) * unit_ms
            outcome, due, error = ("dead", None, str(e)[:1000]) if delivered >= MOST_DELIVERIES else ("retry", now + wait, str(e)[:1000])
        # What waits keeps its line; what is settled keeps its id alone.
        state.update((outcome, delivered, due, value if due else None))
        if due:
            state.setTimeoutDuration(due - now)
        return pd.DataFrame({"event_id": [key[0]], "outcome": [outcome], "delivered": [delivered], "next_try": pd.array([due], "Int64"), "value": [value], "error": [error]})

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            yield attempt(key, held[3], held[1], state)
            return
        value = next((v for pdf in batches for v in pdf["value"]), None)
        if held is None:
            yield attempt(key, value, 0, state)
        elif held[2]:
            # It came again while it waits: the timer goes on.
            state.setTimeoutDuration(max(1, held[2] - state.getCurrentProcessingTimeMs()))

    return run


def deliver(
    spark: SparkSession, source: str, sink: str, checkpoint: str, handler: Callable[[str], None], subject: str = "memory.capture", unit_ms: int = 1000,
    files: int = BATCH_FILES, every: str = "250 milliseconds",
):
    """Hand each event to ``handler`` until it takes it: accepted events and dead letters under ``sink``, each once.

    An event (by id) is a key of the stream's state.  A delivery that fails sets a timer, twice as long each time up to
    ``LONGEST_WAIT``, and the event is delivered again when it runs out; the tenth failure writes a dead letter with
    the last error.  The state is the ledger: an event that comes again, at any time, is not delivered again
    when it is settled, nor before its timer when it waits.  A batch that is run again after a loss delivers again, so a
    handler with effects of its own must be idempotent by event id.
    """
    events = _lines(spark, source, files).where("reason IS NULL").select("event_id", "value")
    settled = events.groupBy("event_id").applyInPandasWithState(_delivery(handler, unit_ms), OUTCOME, LEDGER, "append", GroupStateTimeout.ProcessingTimeTimeout)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.where("outcome = 'accepted'").select("event_id", "delivered", "value").write.mode("overwrite").parquet(f"{sink}/accepted/batch={number}")
        held.where("outcome = 'dead'").select("event_id", "delivered", F.col("error").alias("reason"), F.lit(subject).alias("subject"), F.col("value").alias("payload")).write.mode("overwrite").parquet(f"{sink}/dead/batch={number}")
        held.where("outcome = 'retry'").select("event_id", "delivered", "next_try", "error").write.mode("overwrite").parquet(f"{sink}/retries/batch={number}")
        held.unpersist()

    return settled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows per user: works on a stream (with its watermark) and on a table alike."""
    return events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap)).agg(F.count("*").alias("n"))
