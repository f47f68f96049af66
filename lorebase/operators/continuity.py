"""Sessions: what has changed since a version that a client knows, and transcripts read on from where they were left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters from which a transcript is worth keeping.
LEAST_CHARS = 20


def added(old: Column, new: Column) -> Column:
    """Entries of ``new`` that ``old`` has not, in order, with their repeats."""
    held = F.coalesce(old, F.array().cast("array<string>"))
    return F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: ~F.array_contains(held, x))


def deltas(requests: DataFrame, sessions: DataFrame, checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """What each request (request_id, session_id, known_version) has missed; one row each, of sessions that exist.

    sessions: session_id, version; checkpoints: session_id, version, source_sequence, completed, remaining (arrays); events:
    session_id, sequence, event_id.  A version newer than the session's is ``invalid``, and one whose checkpoint is gone
    ``too old``; version 0 is the beginning.  Else the log is replayed from the sequence that the known checkpoint was made at: the
    events behind it in order, the newest checkpoint if it is newer, and what that has added to the known one.
    """
    known = checkpoints.select("session_id", F.col("version").alias("known_version"), F.col("source_sequence").alias("_base"), F.col("completed").alias("_c"), F.col("remaining").alias("_r"))
    newest = checkpoints.groupBy("session_id").agg(F.max(F.struct("version", "completed", "remaining")).alias("_new"))
    own = requests.join(sessions.select("session_id", F.col("version").alias("to_version")), "session_id")
    status = F.when(F.col("known_version") > F.col("to_version"), "invalid").when((F.col("known_version") > 0) & F.col("_base").isNull(), "too old").otherwise("ok")
    rows = own.join(known, ["session_id", "known_version"], "left").join(newest, "session_id", "left").withColumn("status", status)
    fine = F.col("status") == "ok"
    # A session's requests that start from one sequence share its events: they are gathered once for each.
    bases = rows.where(fine).select("session_id", F.coalesce("_base", F.lit(0)).alias("_from")).distinct()
    behind = bases.join(events.select("session_id", "sequence", "event_id"), "session_id").where(F.col("sequence") > F.col("_from"))
    replayed = behind.groupBy("session_id", "_from").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "event_id"))), lambda e: e["event_id"]).alias("_events"))
    met = rows.withColumn("_from", F.when(fine, F.coalesce("_base", F.lit(0)))).join(replayed, ["session_id", "_from"], "left")
    missed = F.when(fine, F.coalesce("_events", F.array().cast(replayed.schema["_events"].dataType)))
    changed = ~F.col("_new.remaining").eqNullSafe(F.coalesce("_r", F.array().cast("array<string>")))
    return met.select(
        "request_id", "session_id", "known_version", "to_version", "status", (F.size(missed) == 0).alias("no_change"), missed.alias("events"),
        F.when(fine & (F.col("to_version") > F.col("known_version")), F.col("_new.version")).alias("checkpoint"),
        F.when(fine, added(F.col("_c"), F.col("_new.completed"))).alias("completed_added"),
        F.when(fine, F.when(changed, F.coalesce("_new.remaining", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).alias("remaining_changed"),
    )


def said(line: Column) -> Column:
    """``role: text`` of a transcript's JSON line of a user or an assistant, null of any other line.

    The content is a text, or a list of blocks: texts, and objects of which those of type ``text`` are read.
    """
    role = F.get_json_object(line, "$.type")
    content = F.get_json_object(line, "$.message.content")
    blocks = F.from_json(content, "array<string>")
    text_of = lambda b: F.when(F.startswith(F.ltrim(b), F.lit("{")) & F.get_json_object(b, "$.type").isNotNull(), F.when(F.get_json_object(b, "$.type") == "text", F.get_json_object(b, "$.text"))).otherwise(b)
    listed = F.array_join(F.filter(F.transform(blocks, text_of), lambda t: t.isNotNull() & (t != "")), "\n")
    is_list = F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull()
    text = F.regexp_replace(F.when(is_list, listed).otherwise(F.when(F.startswith(F.ltrim(content), F.lit("{")), "").otherwise(content)), r"^\s+|\s+$", "")
    return F.when(role.isin("user", "assistant") & (text != ""), F.concat(role, F.lit(": "), text))


def transcripts(lines: DataFrame, cursors: DataFrame, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Blobs (session_id, blob) of the lines (session_id, line, value) that a session's cursor has not passed, and the new cursors.

    cursors: session_id, lines (read so far).  The cursor moves past lines that cannot be read, and past blobs of fewer than
    ``least`` characters, which are not kept: nothing is read twice.
    """
    seen = cursors.select("session_id", F.col("lines").alias("_seen"))
    new = lines.join(seen, "session_id", "left").where(F.col("line") > F.coalesce("_seen", F.lit(0)))
    told = new.select("session_id", "line", said(F.col("value")).alias("text")).where("text is not null")
    joined = told.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("blob"))
    reached = new.groupBy("session_id").agg(F.max("line").cast("long").alias("_reached"))
    moved = cursors.join(reached, "session_id", "full").select("session_id", F.coalesce("_reached", "lines").alias("lines"))
    return joined.where(F.length("blob") >= least), moved
