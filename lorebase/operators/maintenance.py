"""Retention, retries, resolution and the maintenance run that changes tables, each as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.lifecycle import supersession
from lorebase.sources.scratch import materialize
from lorebase.sources.snapshots import Snapshots

DAY = 86400
#: Seconds that a kind of use keeps a memory, and that a success does; all other kinds none.
KEEPS = {"selected": DAY, "injected": 3 * DAY, "expanded": 14 * DAY, "used": 30 * DAY}
SUCCESS_KEEPS, REVIEW_AFTER = 90 * DAY, 30 * DAY
#: Failures that end a job, the longest wait, and the seconds in which what has run out can be had back.
MOST_ATTEMPTS, LONGEST_DELAY, RECOVERY = 10, 300, 72 * 3600


def retention(memories: DataFrame, usage: DataFrame) -> DataFrame:
    """id, expires_at, review_at of every memory in use, from usage (memory_id, usage_type, used_at, successful).

    A use keeps a memory from its own time on, never shorter than it had; a pinned one never runs out.  Kinds that
    keep nothing change nothing.
    """
    by_kind = F.create_map(*[F.lit(x) for pair in KEEPS.items() for x in pair])
    keeps = F.when(F.col("successful"), SUCCESS_KEEPS).otherwise(F.coalesce(by_kind[F.col("usage_type")], F.lit(0)))
    reviewed = F.col("usage_type").isin("expanded", "used") | F.col("successful")
    uses = usage.groupBy(F.col("memory_id").alias("id")).agg(
        F.max(F.when(keeps > 0, F.col("used_at") + keeps)).alias("_until"), F.max(F.when(reviewed, F.col("used_at") + REVIEW_AFTER)).alias("review_at")
    )
    until = F.when(F.col("lifecycle") == "pinned", None).when(F.col("_until").isNull(), F.col("expires_at")).otherwise(F.greatest("expires_at", "_until"))
    return memories.select("id", "lifecycle", "expires_at").join(uses, "id").select("id", until.alias("expires_at"), "review_at")


def failed_jobs(jobs: DataFrame, now: int, base: int = 1) -> DataFrame:
    """job_id, status, available_at of claimed jobs (job_id, attempts) that failed: dead at the last attempt, else twice as late each time."""
    dead = F.col("attempts") >= MOST_ATTEMPTS
    # Beyond 16 doublings any base is past the longest delay.
    delay = F.least(F.lit(LONGEST_DELAY), base * F.pow(F.lit(2), F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(16))).cast("long"))
    return jobs.select("job_id", F.when(dead, "dead").otherwise("retry").alias("status"), F.when(~dead, now + delay).alias("available_at"))


def oldest_due(jobs: DataFrame, now: int) -> DataFrame:
    """age: seconds since the first due job was due; a claimed job is due when its lease has run out. 0 if none is."""
    at = F.when(F.col("status") == "processing", F.col("lease_until")).when(F.col("status").isin("pending", "retry"), F.col("available_at"))
    return jobs.select(at.alias("at")).where(F.col("at") <= now).agg(F.greatest(F.lit(0), now - F.min("at")).alias("age"))


def disputes(facts: DataFrame) -> DataFrame:
    """Current facts (superseded_at is null) of keys that say more than one thing, with ``wins``: most certain, then newest."""
    current = facts.where("superseded_at is null")
    key = Window.partitionBy("entity_id", "claim_key")
    told = current.withColumn("_low", F.min("claim_value").over(key)).withColumn("_high", F.max("claim_value").over(key)).where("_low <> _high").drop("_low", "_high")
    order = key.orderBy(F.desc("confidence"), F.desc("observed_at"), F.desc("fact_id"))
    return told.withColumn("wins", F.row_number().over(order) == 1)


def untold(entities: DataFrame, margin: int = 50) -> DataFrame:
    """Entities that stay (tier persist) whose timeline says more than their truth."""
    line = F.length(F.coalesce("timeline", F.lit("")))
    return entities.where((F.col("tier") == "persist") & (line > 0) & (line > F.length(F.coalesce("compiled_truth", F.lit(""))) + margin))


def stale(memories: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """id, content, why: memories whose vector is missing, not ready, of another model, or of another text.

    embeddings: memory_id, status, model, content_hash.
    """
    # Digests are taken before the join, so texts travel only for those who read them.
    today = memories.select("id", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("_today"))
    joined = today.join(embeddings, F.col("id") == F.col("memory_id"), "left")
    why = (
        F.when(F.col("memory_id").isNull(), "missing").when(~F.col("status").eqNullSafe("ready"), "not ready").when(~F.col("model").eqNullSafe(model), "model")
        .when(~F.col("content_hash").eqNullSafe(F.col("_today")), "content")
    )
    return joined.select("id", "content", why.alias("why")).where("why is not null")


def _past(now: int) -> Column:
    return F.coalesce(F.col("expires_at") < now - RECOVERY, F.lit(False))


def run_out(memories: DataFrame, now: int) -> DataFrame:
    """Memories past the time in which they can be had back."""
    return memories.where(_past(now))


#: A phase reads the tables of a version and gives the new rows of some, and an audit (table_name, id, change) of what it changes.
Phase = Callable[[Callable[[str], DataFrame]], tuple[dict[str, DataFrame], DataFrame]]


def _audit(rows: DataFrame, table: str, id_: str, change: str) -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), F.col(id_).cast("string").alias("id"), F.lit(change).alias("change"))


def truth_rewrite(table) -> tuple[dict[str, DataFrame], DataFrame]:
    """The first three entries of the timeline, 500 characters at most, become the truth."""
    told = untold(table("entities")).select("id", F.substring(F.array_join(F.slice(F.split(F.trim("timeline"), "\n"), 1, 3), " "), 1, 500).alias("_truth"))
    told = told.join(table("entities").select("id", F.col("compiled_truth").alias("_old")), "id").where(~F.col("_truth").eqNullSafe(F.col("_old"))).drop("_old")
    new = table("entities").join(told, "id", "left").withColumn("compiled_truth", F.coalesce("_truth", "compiled_truth")).drop("_truth")
    return {"entities": new.select(*table("entities").columns)}, _audit(told, "entities", "id", "truth rewritten")


def fact_resolve(now: int) -> Phase:
    def run(table):
        lost = disputes(table("facts")).where("not wins").select("fact_id", F.lit(True).alias("_lost"))
        new = table("facts").join(lost, "fact_id", "left").withColumn("superseded_at", F.when(F.col("_lost"), F.timestamp_seconds(F.lit(now)).cast("date")).otherwise(F.col("superseded_at")))
        return {"facts": new.select(*table("facts").columns)}, _audit(lost, "facts", "fact_id", "superseded")

    return run


def embed_stale(model: str, embed: Callable[[DataFrame], DataFrame]) -> Phase:
    """New vectors, by ``embed`` from (id, content) to (id, vec), for every memory that needs one.

    A memory for which ``embed`` has no vector stays as it is; the audit says so, as nothing else would.
    """

    def run(table):
        # Only ids and digests are kept of what is stale: texts travel once, to those that are embedded, and vectors are made once.
        hashed = table("memories").select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
        todo = materialize(stale(table("memories"), table("embeddings"), model).select("id").distinct(), "stale")
        vectors = embed(table("memories").select("id", "content").join(todo, "id", "left_semi")).where("vec is not null")
        fresh = materialize(vectors.join(hashed, "id").select(F.col("id").alias("memory_id"), F.lit("ready").alias("status"), F.lit(model).alias("model"), "content_hash", "vec"), "fresh")
        kept = table("embeddings").join(fresh.select("memory_id"), "memory_id", "left_anti")
        without = todo.join(fresh.select(F.col("memory_id").alias("id")), "id", "left_anti")
        audit = _audit(fresh, "embeddings", "memory_id", "embedded").unionByName(_audit(without, "embeddings", "id", "not embedded"))
        return {"embeddings": kept.select(*fresh.columns).unionByName(fresh)}, audit

    return run


def purge(now: int, dependents: tuple[str, ...]) -> Phase:
    """Memories that have run out for good go, and what hangs on them (memory_id) goes with them."""

    def run(table):
        gone = run_out(table("memories"), now).select("id")
        ids = gone.select(F.col("id").alias("memory_id"))
        # Who goes is seen from the memory itself, so the texts of those that stay are not dealt.
        new = {"memories": table("memories").where(~_past(now))}
        audit = [_audit(gone, "memories", "id", "deleted")]
        for name in dependents:
            new[name] = table(name).join(ids, "memory_id", "left_anti").select(*table(name).columns)
            audit.append(_audit(table(name).join(ids, "memory_id", "left_semi"), name, "memory_id", "deleted with its memory"))
        return new, reduce(DataFrame.unionByName, audit)

    return run


AUDIT = "version int, phase string, table_name string, id string, change string"
REPORT = "place int, phase string, status string, found long, version int"


def run(store: Snapshots, phases: dict[str, Phase], dry_run: bool = False) -> DataFrame:
    """The phases in order, each a version of its own; place, phase, status, found, version of each.

    A phase reads what the one before it has made.  Its new tables and its rows in ``audit`` are seen together or not at
    all; a phase that fails leaves its version unmade, is reported with its error, and the others go on.  Only the number
    of rows that a phase changes comes to the driver.
    """
    spark, report = store.spark, []
    for place, (name, phase) in enumerate(phases.items(), start=1):
        base = store.version()
        try:
            new, audit = phase(lambda t, at=base: store.table(t, at))
            if dry_run:
                report.append((place, name, "dry run", audit.count(), base))
                continue
            rows = audit.select(F.lit(base + 1).alias("version"), F.lit(name).alias("phase"), "table_name", "id", "change")
            before = store.table("audit", base) if base > 1 else spark.createDataFrame([], AUDIT)
            made = store.commit({**new, "audit": before.unionByName(rows)}, base)
            report.append((place, name, "ok", store.table("audit", made).where(F.col("version") == made).count(), made))
        except Exception as e:  # noqa: BLE001  a phase is kept apart from the others
            report.append((place, name, f"failed: {type(e).__name__}: {e}", 0, base))
    return spark.createDataFrame(report, REPORT)


class PhaseFailed(RuntimeError):
    """A run went on without a phase, so its tables are not those that the whole run makes."""


def whole(report: DataFrame) -> None:
    """``PhaseFailed``, with the phases and their errors, if a run's report has any that failed."""
    failed = [f"{r.phase} {r.status}" for r in report.where(F.col("status").startswith("failed")).orderBy("place").collect()]
    if failed:
        raise PhaseFailed("; ".join(failed))


def opened(spark, root: str, tables: dict[str, DataFrame]) -> Snapshots:
    """A store whose first version holds these tables."""
    store = Snapshots(spark, root)
    store.commit({**tables, "audit": spark.createDataFrame([], AUDIT)}, 0)
    return store


def with_supersession(facts: DataFrame) -> DataFrame:
    """Facts with the end that the next one on their key gives them."""
    return supersession(facts)
