"""Context packs, deliveries, skills, hand-offs and imports: classifications over joined states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.sources.scratch import materialize, tasks_for

#: Statuses that keep a skill from being used, and reviews that end a version.
UNUSABLE, FINAL = ("deprecated", "archived", "stale"), ("approved", "rejected", "deprecated", "archived")
TRUSTED = ("trusted", "high", "owner")
#: Share of the whole pack that a delta may have, and characters by which near copies are told.
DELTA_MAX_RATIO, INDEX_PREFIX = 0.70, 120


def ranked(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df with ``place``, its number in the order of ``keys``; no task sees more than its range of rows.

    Rows are dealt to ranges and numbered inside; what lies in the ranges before is one number each, added by a join.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_n", 33).cast("int")).withColumn("_n", F.col("_n").bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row for each partition.
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_n") + 1).drop("_part", "_n", "_before")


def shadow(candidates: DataFrame, weight: float = 0.1) -> DataFrame:
    """Both ranks of each candidate (run_id, memory_id, score, utility, prod_place) and the move from one to the other."""
    mixed = (1 - weight) * F.col("score") + weight * F.col("utility")
    prod = Window.partitionBy("run_id").orderBy(F.desc("score"), "prod_place")
    ranks = candidates.withColumn("prod", F.row_number().over(prod)).withColumn("mixed", mixed)
    ranks = ranks.withColumn("shadow", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("mixed"), "prod")))
    move = F.when(F.col("shadow") < F.col("prod"), "promote").when(F.col("shadow") > F.col("prod"), "demote").otherwise("unchanged")
    return ranks.withColumn("delta", F.col("prod") - F.col("shadow")).withColumn("move", move)


def reranked(candidates: DataFrame, weight: float) -> DataFrame:
    """Place of each candidate in its run by (1 - w) score + w utility, w between 0 and 0.1."""
    w = min(max(weight, 0.0), 0.1)
    score = F.round((1 - w) * F.col("score") + w * F.col("utility"), 9)
    order = Window.partitionBy("run_id").orderBy(F.desc("final"), "memory_id", "prod_place")
    return candidates.withColumn("final", score).withColumn("place", F.row_number().over(order))


def quality(ranks: DataFrame, k: int, place: str) -> DataFrame:
    """run_id, precision, recall, reciprocal rank, share selected and rows from other scopes, of the first k of each run."""
    inside = F.col(place) <= k
    return ranks.groupBy("run_id").agg(
        (F.count_if(inside & F.col("relevant")) / k).alias("precision"),
        (F.count_if(inside & F.col("relevant")) / F.greatest(F.count_if("relevant"), F.lit(1))).alias("recall"),
        F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col(place))), F.lit(0.0)).alias("reciprocal_rank"),
        (F.count_if(inside & F.col("selected")) / k).alias("selection_rate"),
        F.count_if(inside & F.col("other_scope")).alias("leaked"),
    )


#: Rows of a task that compares two tables.
COMPARED = 1 << 18


def differing(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, differing: the values that only one side has under a key, for keys that have any.

    Both sides are laid in one table, dealt by key to tasks of about ``COMPARED`` rows, and told apart by a bit.
    """
    sides = left.select(key, value, F.lit(1).alias("_side")).unionByName(right.select(key, value, F.lit(2).alias("_side")))
    seen = sides.repartition(tasks_for(sides, COMPARED), key).groupBy(key, value).agg(F.bit_or("_side").alias("_sides"))
    return seen.where("_sides < 3").groupBy(key).agg(F.count("*").alias("differing"))


def skill_versions(drafts: DataFrame) -> DataFrame:
    """skill_id, draft_id, version, replay: a draft that repeats the one before it in content and evidence is a replay of its version."""
    order = Window.partitionBy("skill_id").orderBy("draft_id")
    digest = F.sha2(F.concat_ws("\u0001", "content", "evidence"), 256)
    marked = drafts.withColumn("_d", digest).withColumn("replay", F.coalesce(F.lag("_d").over(order) == F.col("_d"), F.lit(False)))
    return marked.withColumn("version", F.sum((~F.col("replay")).cast("long")).over(order)).select("skill_id", "draft_id", "version", "replay")


def skill_status(skills: DataFrame, reviews: DataFrame, agents: DataFrame) -> DataFrame:
    """skill_id, status, reviews that counted: reviews by the owner or by trusted agents, in order, until one is final."""
    who = reviews.join(skills.select("skill_id", "owner_id"), "skill_id").join(agents.select(F.col("agent_id").alias("reviewer_id"), "trust_level"), "reviewer_id", "left")
    heard = who.where((F.col("reviewer_id") == F.col("owner_id")) | F.col("trust_level").isin(*TRUSTED))
    before = Window.partitionBy("skill_id").orderBy("review_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("decision").isin(*FINAL).cast("int")).over(before), F.lit(0)) == 1
    counted = heard.withColumn("_done", done).where(~F.col("_done"))
    last = counted.groupBy("skill_id").agg(F.max_by("decision", "review_id").alias("decision"), F.count("*").alias("heard"))
    status = F.when(F.col("decision") == "changes_requested", "pending_approval").otherwise(F.coalesce("decision", F.lit("pending_approval")))
    return skills.select("skill_id").join(last, "skill_id", "left").select("skill_id", status.alias("status"), F.coalesce("heard", F.lit(0)).alias("heard"))


def stale_skills(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """skill_id, gone, changed, stale: sources (skill_id, source_id, recorded_hash) that are away, or have another hash now."""
    met = recorded.join(now.select("source_id", "hash"), "source_id", "left")
    return met.groupBy("skill_id").agg(F.count_if(F.col("hash").isNull()).alias("gone"), F.count_if(F.col("hash") != F.col("recorded_hash")).alias("changed")).withColumn(
        "stale", (F.col("gone") > 0) | (F.col("changed") > 0)
    )


def usable(skills: DataFrame, status: DataFrame, stale: DataFrame, repository: str) -> DataFrame:
    """Skills that may be offered in a repository: approved, not stale, of this repository or of none."""
    known = skills.join(status.select("skill_id", F.col("status").alias("review")), "skill_id").join(stale.select("skill_id", "stale"), "skill_id", "left")
    fits = F.col("repository").isNull() | (F.col("repository") == repository)
    return known.where((F.col("review") == "approved") & ~F.coalesce("stale", F.lit(False)) & fits & ~F.col("status").isin(*UNUSABLE))


def client_copies(current: DataFrame, known: DataFrame, usable_ids: DataFrame) -> DataFrame:
    """client_id, skill_id, state of each skill that a client holds (client_id, skill_id, version) or lacks.

    current: client_id, skill_id, version, what it should hold; usable_ids: skills that still exist and are in use.
    """
    c = current.select("client_id", "skill_id", F.col("version").alias("_now"))
    k = known.select("client_id", "skill_id", F.col("version").alias("_held"))
    both = c.join(k, ["client_id", "skill_id"], "full").join(usable_ids.select("skill_id", F.lit(True).alias("_use")), "skill_id", "left")
    now, held = F.col("_now"), F.col("_held")
    state = (
        F.when(held.isNull(), "missing")
        .when(now.isNull(), F.when(F.col("_use").isNull(), "stale_client").otherwise("removed"))
        .when(held == now, "unchanged").when(held < now, "updated").otherwise("stale_client")
    )
    return both.select("client_id", "skill_id", state.alias("state"))


def cache_validity(entries: DataFrame, dependencies: DataFrame, now_hash: DataFrame, policy: str, now: int) -> DataFrame:
    """entry_id, valid, reason: status, age, policy, then the dependencies (entry_id, source_id, hash) against today's hashes."""
    judged = (F.col("status") != "fresh") | (F.col("expires_at") <= now) | (F.col("policy_version") != policy)
    # Entries that are judged without their dependencies do not look them up.
    unsure = entries.where(~F.coalesce(judged, F.lit(False))).select("entry_id")
    met = dependencies.join(unsure, "entry_id", "left_semi").join(now_hash.select("source_id", F.col("hash").alias("_today")), "source_id", "left")
    deps = met.groupBy("entry_id").agg(F.count_if(F.coalesce(F.col("_today") != F.col("hash"), F.lit(True))).alias("bad"))
    reason = (
        F.when(F.col("status") != "fresh", F.col("status"))
        .when(F.col("expires_at") <= now, "ttl_expired")
        .when(F.col("policy_version") != policy, "policy_changed")
        .when(F.col("bad").isNull(), "missing_dependencies")
        .when(F.col("bad") > 0, "source_changed")
    )
    return entries.join(deps, "entry_id", "left").select("entry_id", reason.isNull().alias("valid"), reason.alias("reason"))


def _print(lines: Column) -> Column:
    """One digest over sorted lines (kind, dep_id, hash)."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["kind"], x["dep_id"], x["hash"])), ","), 256))


def dependency_print(dependencies: DataFrame) -> DataFrame:
    """entry_id, print: one digest over all that an entry depends on (kind, dep_id, hash), in order of kind and id."""
    return dependencies.groupBy("entry_id").agg(_print(F.sort_array(F.collect_list(F.struct("kind", "dep_id", "hash")))).alias("print"))


def typed_validity(entries: DataFrame, recorded: DataFrame, current: DataFrame, policy: str, now: int) -> DataFrame:
    """entry_id, valid, reason, changed (kinds, joined): status, age, policy, then sources of every kind against what they are now.

    entries: entry_id, status, expires_at, policy_version, print; recorded: entry_id, kind, dep_id, hash; current: kind, dep_id,
    hash, one row for each source, whatever hangs on it, so a source that changes or goes takes all its entries
    along.  An entry whose recorded rows are no longer those of its digest is ``dependency_mismatch``.  Where entries bring no
    print, it is that of the recorded rows with those that are ``lost`` (boolean) since, so they are read and dealt once.
    """
    lost = F.col("lost") if "lost" in recorded.columns else F.lit(False)
    met = recorded.withColumn("lost", lost).join(current.select("kind", "dep_id", F.col("hash").alias("_now")), ["kind", "dep_id"], "left")
    rows = met.select("entry_id", "kind", "dep_id", "hash", "lost", (~F.col("lost") & ~F.col("hash").eqNullSafe(F.col("_now"))).alias("bad"))
    lines = rows.repartition("entry_id").groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("kind", "dep_id", "hash", "lost", "bad"))).alias("_lines"))
    held = F.filter("_lines", lambda x: ~x["lost"])
    kinds = F.array_distinct(F.transform(F.filter(held, lambda x: x["bad"]), lambda x: x["kind"]))
    found = lines.select("entry_id", F.when(F.size(held) > 0, F.array_join(kinds, ",")).alias("changed"), _print(held).alias("_print"), _print(F.col("_lines")).alias("_whole"))
    rows = entries.join(found, "entry_id", "left").withColumn("print", F.col("print") if "print" in entries.columns else F.col("_whole"))
    reason = (
        F.when(F.col("status") != "fresh", F.col("status")).when(F.col("expires_at") <= now, "ttl_expired").when(F.col("policy_version") != policy, "policy_changed")
        .when(F.col("changed").isNull(), "missing_dependencies").when(F.col("changed") != "", "source_changed").when(F.col("_print") != F.col("print"), "dependency_mismatch")
    )
    return rows.select("entry_id", reason.isNull().alias("valid"), reason.alias("reason"), F.coalesce("changed", F.lit("")).alias("changed"))


#: Items of a task that lays packs beside one another.
LAID = 1 << 18


def sections(packs: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, place, item, tokens, here, old: the places of each pack and of the one before, from packs (pack_id, next_id) and items (pack_id, place, memory_id, tokens).

    Items are dealt by pack once and go to their own pack and to the next one together, so both are read in one pass; what
    comes out is dealt by request, to tasks of about ``LAID`` items.  ``here`` is false at a place that only the pack before had.
    """
    tasks = tasks_for(items, LAID)
    own = items.select("pack_id", "place", "memory_id", "tokens").repartition(tasks, "pack_id").groupBy("pack_id", "place").agg(F.min("memory_id").alias("item"), F.min("tokens").alias("tokens"))
    met = own.join(packs, "pack_id")
    # A row without a next pack is sent to its own alone.
    to = F.when(F.col("next_id").isNull(), F.array("pack_id")).otherwise(F.array("pack_id", "next_id"))
    sent = met.select(F.posexplode(to).alias("_step", "request_id"), "place", "item", "tokens").repartition(tasks, "request_id")
    now = F.col("_step") == 0
    return sent.groupBy("request_id", "place").agg(
        F.max(F.when(now, F.col("item"))).alias("item"), F.max(F.when(now, F.col("tokens"))).alias("tokens"), F.bool_or(now).alias("here"), F.max(F.when(~now, F.col("item"))).alias("old")
    )


def section_delta(rows: DataFrame) -> DataFrame:
    """request_id, added, removed, changed, same: counts of the places that ``sections`` gives."""
    return rows.groupBy("request_id").agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("item").isNull()).alias("removed"),
        F.count_if(F.col("item") != F.col("old")).alias("changed"), F.count_if(F.col("item") == F.col("old")).alias("same"),
    )


def delivery_mode(states: DataFrame, *kept: str) -> DataFrame:
    """request_id, mode, delivered, avoided, ratio, and the columns to be kept, for requests with what is known of the client and of what has changed.

    states: has_state, delta_capable, cache_fallback, known_checkpoint, checkpoint, known_pack, refresh (skills or
    hand-offs that must be fetched anew), changes (of sections, skills and hand-offs), full_tokens, delta_tokens.
    """
    rejected = F.col("known_checkpoint") > F.col("checkpoint")
    plain = ~F.col("has_state") | ~F.col("delta_capable")
    first = (
        F.when(plain, "full")
        .when(F.col("cache_fallback").startswith("cache_lookup_failed:") | rejected, "fallback_full")
        .when(F.col("known_pack").isNull(), "full")
        .when(F.col("refresh") > 0, "refresh_required")
        .when(F.col("changes") == 0, "no_change")
        .otherwise("delta")
    )
    rows = states.withColumn("_m", first)
    too_big = (F.col("_m") == "delta") & (F.col("delta_tokens") > F.col("full_tokens") * DELTA_MAX_RATIO)
    rows = rows.withColumn("mode", F.when(too_big, "full").otherwise(F.col("_m")))
    delivered = F.when(F.col("mode").isin("full", "fallback_full"), F.col("full_tokens")).otherwise(F.col("delta_tokens"))
    avoided = F.greatest(F.col("full_tokens") - delivered, F.lit(0))
    return rows.select("request_id", "mode", delivered.alias("delivered"), avoided.alias("avoided"), F.round(avoided / F.col("full_tokens"), 6).alias("ratio"), *kept)


def authority(kind: Column, trust: Column, said_by_user: Column) -> Column:
    """struct(authority, verification, source_type) of a source by the start of its reference, else by who said it."""
    low = F.lower(kind)
    told = lambda a, v, s: F.struct(F.lit(a).alias("authority"), F.lit(v).alias("verification"), F.lit(s).alias("source_type"))
    starts = lambda *p: low.rlike("^(" + "|".join(p) + ")")
    return (
        F.when(starts("repository:", "file:", "git:"), told("repository_evidence", "verified", "repository"))
        .when(low.rlike("tool:|test:|command:"), told("successful_tool_output", "verified", "tool"))
        .when(starts("http://", "https://", "external:"), told("external_content", "unverified", "external"))
        .when(said_by_user, told("user_factual_statement", "stated", "user"))
        .when(trust.isin("trusted", "high"), told("trusted_agent_conclusion", "agent_attested", "agent"))
        .otherwise(told("unverified_agent_statement", "unverified", "agent"))
    )


def import_plan(rows: DataFrame, present: DataFrame, now: int) -> DataFrame:
    """id, verdict, bytes of legacy rows (id, content, created_at, expires_at) in the order of (created_at, id).

    Every valid row registers its text before it is judged, so later ones repeat it even where it is not imported.
    Rows meet by digest, so texts are not sorted.
    """
    bad = F.col("id").isNull() | (F.coalesce("content", F.lit("")) == "") | F.col("created_at").isNull()
    lean = rows.select(
        "id", "created_at", "expires_at", bad.alias("_bad"), F.sha2("content", 256).alias("_text"), F.sha2(F.substring("content", 1, INDEX_PREFIX), 256).alias("_start"),
        F.octet_length("content").cast("long").alias("bytes"),
    )
    valid = lean.where("NOT _bad")
    order = F.struct("created_at", "id")
    firsts = lambda c: valid.groupBy(c).agg(F.min(order).alias(f"_f{c}"))
    seen = lean.join(firsts("_text"), "_text", "left").join(firsts("_start"), "_start", "left").join(present.select("id", F.lit(True).alias("_here")), "id", "left")
    verdict = (
        F.when(F.col("_bad"), "invalid").when(F.col("_here"), "already_present").when(F.col("expires_at") < now, "expired")
        .when(order != F.col("_f_text"), "exact_duplicate").when(order != F.col("_f_start"), "near_duplicate").otherwise("import")
    )
    return seen.select("id", "created_at", verdict.alias("verdict"), "bytes")


def conformed(df: DataFrame, wanted: list[str], required: list[str]) -> DataFrame:
    """The wanted columns that a foreign table has, in order; an error if one that is required is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[c for c in wanted if c in df.columns])


def replays(arrivals: DataFrame, held: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, verdict: what came with a key is new, a replay of what is held, or in conflict with it in some field."""
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0002")) for f in fields]), 256)
    came = arrivals.select(key, digest.alias("_a")).groupBy(key).agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    met = came.join(held.select(key, digest.alias("_h")), key, "left")
    same = (F.col("_lo") == F.col("_hi")) & (F.coalesce("_h", "_lo") == F.col("_lo"))
    return met.select(key, F.when(~same, "conflict").when(F.col("_h").isNull(), "new").otherwise("replay").alias("verdict"))
