"""Stateful folds against plain Python."""

import random

from lorebase.operators import sequence
from lorebase.plans.sequence_queries import QUERIES


def test_rate_limit_counts_admitted_calls_only(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(900), i) for i in range(400)] + [(None, 1, 900), (1, None, 901)]
    got = {r.call_id: r.admitted for r in sequence.rate_limited(spark.createDataFrame(rows, "caller long, at long, call_id long"), 3, 20).collect()}
    want, kept = {900: False, 901: False}, {}
    for caller, at, i in sorted(rows[:400], key=lambda r: (r[1], r[2])):
        recent = [t for t in kept.get(caller, []) if t > at - 20]
        want[i] = len(recent) < 3
        kept[caller] = recent + [at] * want[i]
    assert got == want and len(set(want.values())) == 2


def test_handoff_goes_only_where_it_may(spark):
    steps = ["claimed", "ready", "claimed", None, "draft", "completed", "blocked"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)] + [(2, 0, "cancelled"), (2, 1, "ready")], "handoff_id long, seq long, wanted string")
    got = [(r.handoff_id, r.status) for r in sequence.handoff_states(df).orderBy("handoff_id", "seq").collect()]
    assert got == [(1, s) for s in ("draft", "ready", "claimed", "claimed", "claimed", "completed", "completed")] + [(2, "cancelled")] * 2


def test_allocation(spark):
    rows = [
        ("q", 1, 1, "a", 100, None, 10, "one", False),
        ("q", 2, 2, "a", 100, None, 10, "one", False),
        ("q", 3, 3, "b", 500, 40, 10, "two", False),
        ("q", 4, 4, "a", 20, None, 10, "three", True),
        ("q", 5, 5, "a", 20, None, 10, "four", False),
        ("q", 6, 6, "c", 170, None, 200, "five", False),
        ("r", 1, 7, "c", 170, None, 200, "five", False),
    ]
    df = spark.createDataFrame(rows, "request string, place long, id long, category string, content_tokens long, summary_tokens long, reference_tokens long, text_key string, needs_check boolean")
    got = {r.id: r.disposition for r in sequence.allocate(df, 600).collect()}
    assert got == {1: "inline", 2: "omitted", 3: "summary", 4: "reference", 5: "reference", 6: "omitted", 7: "inline"}


def test_handoffs_run_out_and_are_superseded(spark):
    """Steps, hand-offs and checkpoints of their tasks in one order of time."""
    steps = [
        (1, 1, "ready", 10), (1, 2, "claimed", 20), (1, 3, "in_progress", 95), (1, 4, "completed", 120),  # runs out at 100: too late
        (2, 1, "ready", 10), (2, 2, "claimed", 60), (2, 3, "claimed", 70),  # task 8 has a newer checkpoint from 50 on
        (3, 1, "ready", 10), (3, 2, "claimed", 40), (3, 3, "completed", 60), (3, 4, "ready", 61), (3, 5, "blocked", 62),  # work done may be handed in late, but not gone on with
        (4, 1, "ready", 500), (4, 2, "expired", 501), (4, 3, "claimed", 502),  # never runs out
        (5, 1, "ready", 10), (5, 2, "expired", 300),  # asked for: no step of its own
    ]
    steps = spark.createDataFrame(steps, "handoff_id long, seq long, wanted string, at long")
    terms = spark.createDataFrame([(1, 7, 1, 100), (2, 8, 1, None), (3, 8, 1, 1000), (4, 9, 1, None), (5, 7, 1, 100)], "handoff_id long, task_id long, checkpoint long, expires_at long")
    log = spark.createDataFrame([(7, 0, 1), (8, 0, 1), (8, 50, 2), (8, 50, 3)], "task_id long, at long, version long")
    got = {}
    for r in sequence.handoff_states(steps, terms, log).orderBy("handoff_id", "seq").collect():
        got.setdefault(r.handoff_id, []).append((r.status, r.reason))
    stale, old = ("superseded", "source_state_changed"), ("expired", "ttl_elapsed")
    assert got[1] == [("ready", None), ("claimed", None), ("in_progress", None), old]
    assert got[2] == [("ready", None), stale, stale]
    assert got[3] == [("ready", None), ("claimed", None), ("completed", None), ("completed", "conflict"), stale]
    assert got[4] == [("ready", None), ("expired", None), ("expired", "conflict")]
    assert got[5] == [("ready", None), ("expired", None)]


def _packed(spark, requests, items):
    r = spark.createDataFrame(requests, "request long, budget long, mandatory_tokens long, continuity_tokens long, continuity_brief_tokens long, references boolean")
    i = spark.createDataFrame(items, "request long, kind string, place long, category string, content_tokens long, summary_tokens long, reference_tokens long, text_key string, needs_check boolean")
    packed = sequence.pack(r, i).persist()
    return {(x.request, x.place): (x.disposition, x.tokens) for x in packed.collect()}, {x.request: x for x in sequence.token_usage(r, packed).collect()}


def test_pack_within_a_budget(spark):
    """The published example: 220 mandatory and 70 continuity tokens of 800, seven memories of the project; 490 delivered, 700 left out."""
    memory = lambda place, category, content, reference, text, check=False: (1, "memory", place, category, content, None, reference, text, check)
    items = [
        memory(1, "code", 90, 30, "evidence"), memory(2, "code", 85, 30, "evidence"), memory(3, "output", 320, 30, "long output"), memory(4, "history", 120, 200, "stale", True),
        memory(5, "claim", 85, 200, "corrected", True), memory(6, "code", 80, 30, "reuse"), memory(7, "claim", 90, 200, "contradicted", True),
    ]
    got, usage = _packed(spark, [(1, 800, 220, 70, 70, True)], items)
    assert [got[1, k][0] for k in range(1, 8)] == ["inline", "omitted", "reference", "omitted", "omitted", "inline", "omitted"]
    u = usage[1]
    assert (u.estimated_total, u.retrieval_tokens, u.reference_tokens, u.skill_tokens) == (490, 170, 30, 0)
    # The reference's content waits outside the pack, as the omitted texts do.
    assert u.omitted_tokens + 320 == 700 and u.estimated_total <= u.budget and not u.over_budget


def test_what_must_be_there_is_never_cut(spark):
    skill = lambda r, place, content, summary, ref=10: (r, "skill", place, "", content, summary, ref, f"s{place}", False)
    memory = lambda r, place, content, summary=None, ref=10: (r, "memory", place, "c", content, summary, ref, f"t{place}", False)
    requests = [(1, 100, 500, 10, 10, True), (2, 1000, 100, 400, 50, True), (3, 1000, 100, 300, 50, False), (4, 1000, 750, 0, 0, True)]
    items = [
        memory(1, 1, 5), skill(1, 1, 5, None),
        skill(2, 1, 100, None), skill(2, 2, 100, 40), skill(2, 3, 200, 20), memory(2, 1, 150), memory(2, 2, 400, 100), memory(2, 3, 10),
        skill(3, 1, 500, 149), memory(3, 1, 181, 20), memory(3, 2, 181, 181),
        skill(4, 1, 100, 10), memory(4, 1, 5),
    ]
    got, usage = _packed(spark, requests, [(*i[:2], k, *i[3:]) for k, i in enumerate(items)])
    at = lambda k: got[items[k][0], k]
    # Nothing fits, and all that must be there is.
    assert at(0) == at(1) == ("omitted", 0) and usage[1].over_budget and usage[1].estimated_total == 510
    # Continuity past three tenths is shortened; skills take 150 at most, by summaries where contents do not fit, then references.
    assert usage[2].compacted and usage[2].continuity_tokens == 50
    assert [at(k) for k in range(2, 8)] == [("inline", 100), ("summary", 40), ("reference", 10), ("inline", 150), ("summary", 100), ("reference", 10)]
    assert not usage[3].compacted and [at(k) for k in range(8, 11)] == [("summary", 149), ("summary", 20), ("omitted", 0)]
    # 150 tokens are left: references and skills may take them all, so nothing is kept for retrieval.
    assert at(11) == ("inline", 100) and at(12) == ("reference", 10)


def test_as_of(spark):
    log = spark.createDataFrame([(1, 5, 1), (1, 9, 4), (1, 9, 2), (2, 0, 7), (3, 1, None)], "k long, t long, v long")
    steps = spark.createDataFrame([(1, 4, "a"), (1, 5, "b"), (1, 8, "c"), (1, 9, "d"), (2, 100, "e"), (3, 5, "f"), (4, 5, "g")], "k long, t long, name string")
    got = {r.name: r.x for r in sequence.as_of(steps, log, "k", "t", "v", "x").collect()}
    assert got == {"a": None, "b": 1, "c": 1, "d": 4, "e": 7, "f": None, "g": None}


def test_queries_keep_every_row(spark):
    sf = "/root/testdata/sf0.001"
    for name, table in (("rate_limit", "events"), ("handoff_fsm", "lineitem"), ("context_allocate", "documents")):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
