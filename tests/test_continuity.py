"""Deltas from a known version and transcripts read on, by small examples."""

import json

from lorebase.operators import continuity as C


def test_deltas(spark):
    frame = spark.createDataFrame
    sessions = frame([(1, 3), (2, 0), (3, 2)], "session_id long, version long")
    saves = frame(
        [(1, 1, 2, ["a"], ["x", "y"]), (1, 3, 5, ["a", "b", "b", "c"], ["y"]), (3, 1, 4, ["a"], ["x"]), (3, 2, 4, ["a"], ["x"])],
        "session_id long, version long, source_sequence long, completed array<string>, remaining array<string>",
    )
    events = frame([(1, n, 100 + n) for n in (7, 1, 2, 6, 3, 5, 4)] + [(2, 1, 201), (3, 4, 304)], "session_id long, sequence long, event_id long")
    requests = frame([(1, 1, 1), (2, 1, 3), (3, 1, 2), (4, 1, 4), (5, 1, 0), (6, 2, 0), (7, 2, 1), (8, 3, 1), (9, 9, 0)], "request_id long, session_id long, known_version long")
    got = {r.request_id: r for r in C.deltas(requests, sessions, saves, events).collect()}
    seen = lambda i: (got[i].status, got[i].events, got[i].checkpoint, got[i].completed_added, got[i].remaining_changed, got[i].no_change)
    assert seen(1) == ("ok", [103, 104, 105, 106, 107], 3, ["b", "b", "c"], ["y"], False)
    assert seen(2) == ("ok", [106, 107], None, [], [], False)
    assert seen(3) == ("too old", None, None, None, None, None) and seen(4)[0] == "invalid" and seen(7)[0] == "invalid"
    assert seen(5) == ("ok", [101, 102, 103, 104, 105, 106, 107], 3, ["a", "b", "b", "c"], ["y"], False)
    assert seen(6) == ("ok", [201], None, [], [], False) and seen(8) == ("ok", [], 2, [], [], True)
    # A session that is not there has no answer.
    assert 9 not in got


def test_transcripts(spark):
    line = lambda kind, content: json.dumps({"type": kind, "message": {"content": content}})
    lines = [
        line("user", "  a plain question about it "), line("system", "not said"), "{broken", "", line("assistant", [{"type": "text", "text": "one"}, {"type": "tool_use", "id": 1}, "two", {"type": "text", "text": ""}]),
        line("assistant", []), line("user", None), json.dumps({"type": "user"}), line("user", {"text": "an object is no content"}), line("user", "[brackets] are words"), line("assistant", ["{braces} too"]), line("user", '"quoted"'),
    ]
    rows = [(1, n, v) for n, v in enumerate(lines, start=1)] + [(2, 1, line("user", "short")), (3, 1, line("user", "read before, all of it")), (3, 2, line("user", "and this is new, so it counts"))]
    frame = spark.createDataFrame(rows, "session_id long, line long, value string")
    cursors = spark.createDataFrame([(3, 1), (4, 7)], "session_id long, lines long")
    blobs, moved = C.transcripts(frame, cursors)
    assert {r.session_id: r.blob for r in blobs.collect()} == {
        1: 'user: a plain question about it\nassistant: one\ntwo\nuser: [brackets] are words\nassistant: {braces} too\nuser: "quoted"', 3: "user: and this is new, so it counts",
    }
    after = {r.session_id: r.lines for r in moved.collect()}
    assert after == {1: 12, 2: 1, 3: 2, 4: 7}
    # Nothing is read twice.
    assert C.transcripts(frame, moved)[0].count() == 0
