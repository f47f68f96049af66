"""Sessions and transcripts; SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import continuity as C
from lorebase.sources.views import view


def session_delta(spark, d):
    """What each client has missed since the version that it knows."""
    saves = view(spark, d, "session_saves").withColumns({c: F.split(c, "[|]") for c in ("completed", "remaining")})
    rows = C.deltas(view(spark, d, "delta_requests"), view(spark, d, "session_heads"), saves, view(spark, d, "session_log").withColumnRenamed("seq", "sequence"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)
    return rows.select("request_id", "status", "to_version", "no_change", "checkpoint", listed("events"), listed("completed_added"), listed("remaining_changed"))


def _transcripts(spark, d):
    """Turns as JSON lines: contents as texts and as lists of blocks, and lines that are none, after a cursor for some sessions."""
    turns = view(spark, d, "conversation_lines")
    text, block = F.col("text"), lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(text.alias("content")).alias("message")))
    blocks = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(block("text", text), block("thinking", F.lit("not said")), block("text", F.lit("and so on"))).alias("content")).alias("message")))
    lines = turns.select("session_id", "line", F.when(F.col("line") % 5 == 0, "{not json").when(F.col("line") % 2 == 0, plain).otherwise(blocks).alias("value"))
    return lines, view(spark, d, "transcript_cursors")


def transcript_capture(spark, d):
    """What is new in each session's transcript."""
    return C.transcripts(*_transcripts(spark, d))[0]


def transcript_cursor(spark, d):
    """Where each session's transcript is read on."""
    return C.transcripts(*_transcripts(spark, d))[1]


QUERIES = {f.__name__: f for f in (session_delta, transcript_capture, transcript_cursor)}

_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "session_delta": """WITH r AS (SELECT q.*, h.version AS head, s.source_sequence AS base, string_split(s.completed, '|') AS c0, s.remaining AS r0 FROM delta_requests q JOIN session_heads h ON h.session_id = q.session_id
 LEFT JOIN session_saves s ON s.session_id = q.session_id AND s.version = q.known_version),
t AS (SELECT *, CASE WHEN known_version > head THEN 'invalid' WHEN known_version > 0 AND base IS NULL THEN 'too old' ELSE 'ok' END AS status FROM r),
newest AS (SELECT session_id, max(version) AS v FROM session_saves GROUP BY session_id),
n AS (SELECT s.session_id, s.version, string_split(s.completed, '|') AS c1, s.remaining AS r1 FROM session_saves s JOIN newest w ON w.session_id = s.session_id AND w.v = s.version),
e AS (SELECT t.request_id, string_agg(event_id::VARCHAR, '|' ORDER BY seq) AS events FROM t JOIN session_log l ON l.session_id = t.session_id AND l.seq > coalesce(t.base, 0) WHERE status = 'ok' GROUP BY t.request_id)
SELECT t.request_id, status, head AS to_version, CASE WHEN status = 'ok' THEN events IS NULL END AS no_change, CASE WHEN status = 'ok' AND head > known_version THEN n.version END AS checkpoint, CASE WHEN status = 'ok' THEN coalesce(events, '') END AS events,
 CASE WHEN status = 'ok' THEN array_to_string(coalesce(list_filter(c1, lambda x: NOT list_contains(coalesce(c0, []), x)), []), '|') END AS completed_added, CASE WHEN status = 'ok' THEN CASE WHEN r1 IS DISTINCT FROM r0 THEN coalesce(r1, '') ELSE '' END END AS remaining_changed
FROM t LEFT JOIN n ON n.session_id = t.session_id LEFT JOIN e ON e.request_id = t.request_id""",
    "transcript_capture": f"""WITH s AS (SELECT c.session_id, line, role, CASE WHEN line % 2 = 0 THEN {_trim("coalesce(text, '')")} ELSE {_trim("CASE WHEN coalesce(text, '') = '' THEN 'and so on' ELSE concat(text, chr(10), 'and so on') END")} END AS told
 FROM conversation_lines c LEFT JOIN transcript_cursors k ON k.session_id = c.session_id WHERE line > coalesce(k.lines, 0) AND line % 5 > 0 AND role IN ('user', 'assistant')),
b AS (SELECT session_id, string_agg(concat(role, ': ', told), chr(10) ORDER BY line) AS blob FROM s WHERE told <> '' GROUP BY session_id) SELECT * FROM b WHERE length(blob) >= 20""",
    "transcript_cursor": "SELECT coalesce(a.session_id, k.session_id) AS session_id, greatest(a.n, k.lines) AS lines FROM (SELECT session_id, max(line)::BIGINT AS n FROM conversation_lines GROUP BY session_id) a FULL JOIN transcript_cursors k ON k.session_id = a.session_id",
}
