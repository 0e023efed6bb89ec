"""Batches of write commands: which are applied, and the rows they append.

Every command has (command_id, arrival); within a batch the first by arrival wins. Ids of new rows
are hashes of the command, so that a batch that is run again appends the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.feedback import CONTENT, RETRIEVAL
from palimpsest.operators.graph import latest_redirects
from palimpsest.operators.temporal import instant, latest

# The space that cannot be deleted, duplicates of one merge, a lease, attempts of a job.
DEFAULT_SPACE = "default"
MOST_DUPLICATES = 50
LEASE = "INTERVAL 15 MINUTES"
MOST_ATTEMPTS = 3


def new_id(*parts: str | Column) -> Column:
    """An id that follows from its parts."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _first(keys: list[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy("arrival", "command_id")) == 1


def create(memories: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands`` (command_id, arrival, space_id, idempotency_key, logical_key, ...) with ``outcome``:
    ``repeated`` if the space has the idempotency key already, there or earlier in the batch,
    ``conflict`` if it has the logical key, else ``created``, and the new ``memory_id``."""
    keyed = memories.filter("idempotency_key IS NOT NULL").select("space_id", "idempotency_key").distinct().withColumn("_seen", F.lit(True))
    named = memories.filter("logical_key IS NOT NULL").select("space_id", "logical_key").distinct().withColumn("_taken", F.lit(True))
    known = commands.join(keyed, ["space_id", "idempotency_key"], "left").join(named, ["space_id", "logical_key"], "left")
    # Commands without a key stand alone.
    alone = lambda key: F.coalesce(key, F.concat(F.lit("\u001f"), "command_id"))
    again = F.col("idempotency_key").isNotNull() & (F.col("_seen").isNotNull() | ~_first(["space_id", alone("idempotency_key")]))
    judged = known.withColumn("_again", again)
    taken = F.col("logical_key").isNotNull() & (F.col("_taken").isNotNull() | ~_first(["_again", "space_id", alone("logical_key")]))
    outcome = F.when(F.col("_again"), "repeated").when(taken, "conflict").otherwise("created")
    done = judged.withColumn("outcome", outcome).drop("_seen", "_taken", "_again")
    return done.withColumn("memory_id", F.when(F.col("outcome") == "created", new_id("space_id", "command_id")))


def first_rows(created: DataFrame) -> dict[str, DataFrame]:
    """What the ``created`` commands append: the first revision, its tags and sources, the first
    state event and an index job. ``created`` also has title, kind, tags, sources."""
    new = created.filter("outcome = 'created'").withColumn("revision_id", new_id("memory_id", F.lit("1")))
    return {
        "revisions": new.select(F.col("revision_id").alias("id"), "memory_id", "space_id", F.lit(1).alias("revision_number"), "title", "kind", F.col("arrival").alias("recorded_at")),
        "tags": new.select("revision_id", F.explode(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))).alias("tag")),
        "sources": new.select("revision_id", F.posexplode("sources").alias("ordinal", "source")).select("revision_id", "ordinal", "source.*"),
        "events": new.select(new_id("memory_id", F.lit("event"), F.lit("1")).alias("id"), "memory_id", F.lit(1).alias("event_number"), F.lit("active").alias("state"), F.col("arrival").alias("recorded_at")),
        "jobs": new.select("revision_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("arrival").alias("updated_at")),
    }


def record_feedback(feedback: DataFrame, revisions: DataFrame, heads: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands`` (command_id, arrival, memory_id, revision_id, scope, signal, query, idempotency_key)
    with the revision they concern, ``request_hash`` and ``outcome``: ``invalid`` (signal of another
    scope; a retrieval signal without revision or query; a content signal with query), ``unknown`` (no
    such memory, or a revision of another), ``repeated`` or ``conflict`` (the memory has the
    idempotency key, with the same request or another), else ``recorded``."""
    content = (F.col("scope") == "content") & F.col("signal").isin(*CONTENT) & F.col("query").isNull()
    found = (F.col("scope") == "retrieval") & F.col("signal").isin(*RETRIEVAL) & F.col("revision_id").isNotNull() & (F.trim("query") != "")
    current = heads.select("memory_id", F.col("id").alias("_head"))
    owners = revisions.select(F.col("id").alias("revision_id"), F.col("memory_id").alias("_owner")).distinct()
    known = (
        commands.withColumn("_valid", F.coalesce(content, F.lit(False)) | F.coalesce(found, F.lit(False)))
        .join(current, "memory_id", "left")
        .withColumn("revision_id", F.coalesce("revision_id", "_head"))
        .join(owners, "revision_id", "left")
        .withColumn("request_hash", new_id(*[F.coalesce(F.col(c), F.lit("\u0000")) for c in ("memory_id", "revision_id", "scope", "signal", "query")]))
    )
    before = feedback.filter("idempotency_key IS NOT NULL").select("memory_id", "idempotency_key", F.col("request_hash").alias("_before")).dropDuplicates(["memory_id", "idempotency_key"])
    joined = known.join(before, ["memory_id", "idempotency_key"], "left").withColumn("_sound", F.col("_valid") & F.col("_owner").eqNullSafe(F.col("memory_id")) & F.col("_head").isNotNull())
    batch = Window.partitionBy("memory_id", "idempotency_key", "_sound").orderBy("arrival", "command_id")
    earlier = F.when(F.col("idempotency_key").isNotNull() & (F.row_number().over(batch) > 1), F.first("request_hash").over(batch))
    joined = joined.withColumn("_before", F.coalesce("_before", earlier))
    outcome = (
        F.when(~F.col("_valid"), "invalid").when(~F.col("_sound"), "unknown")
        .when(F.col("_before").isNotNull(), F.when(F.col("_before") == F.col("request_hash"), "repeated").otherwise("conflict")).otherwise("recorded")
    )
    return joined.withColumn("outcome", outcome).drop("_valid", "_head", "_owner", "_before", "_sound")


def change_spaces(spaces: DataFrame, commands: DataFrame) -> DataFrame:
    """``spaces`` after ``commands`` (command_id, arrival, space_id, action): ``create`` adds a space that
    is not there, ``delete`` marks it, but for the default space, and ``restore`` takes the mark away.
    The last deletion or restoration counts; what a space holds is not touched."""
    listed = spaces.dropDuplicates(["id"])
    made = latest(commands.filter("action = 'create'"), ["space_id"], [F.asc("arrival"), F.asc("command_id")])
    names = set(listed.columns) - {"id", "created_at", "deleted_at"}
    fresh = made.join(listed.select(F.col("id").alias("space_id")), "space_id", "left_anti").select(
        F.col("space_id").alias("id"), F.col("arrival").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"), *[F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in sorted(names)]
    )
    marks = commands.filter(F.col("action").isin("delete", "restore") & ~((F.col("action") == "delete") & (F.col("space_id") == DEFAULT_SPACE)))
    last = latest(marks, ["space_id"], [F.desc("arrival"), F.desc("command_id")]).select(F.col("space_id").alias("id"), "action", F.col("arrival").alias("_at"))
    every = listed.unionByName(fresh.select(*listed.columns)).join(last, "id", "left")
    # A space that is deleted already keeps its first mark.
    gone = F.when(F.col("action") == "restore", F.lit(None)).when(F.col("action") == "delete", F.coalesce("deleted_at", "_at")).otherwise(F.col("deleted_at"))
    return every.withColumn("deleted_at", gone).select(*listed.columns)


def revise(heads: DataFrame, redirects: DataFrame, commands: DataFrame) -> DataFrame:
    """:func:`palimpsest.operators.mutate.compare_and_append` for memories that are not merged away;
    commands on those are ``merged``."""
    from palimpsest.operators.mutate import compare_and_append

    moved = redirects.select(F.col("source_memory_id").alias("memory_id")).distinct()
    free = compare_and_append(heads, commands.join(moved, "memory_id", "left_anti"))
    return free.unionByName(commands.join(moved, "memory_id", "left_semi").select("command_id", "memory_id", F.lit("merged").alias("outcome"), F.lit(None).cast("int").alias("revision_number")))


def merge(heads: DataFrame, memories: DataFrame, redirects: DataFrame, members: DataFrame) -> DataFrame:
    """Merge operations: ``members`` (operation_id, arrival, canonical_id, canonical_revision_id,
    duplicate_id, duplicate_revision_id) with ``outcome``, the same for all of an operation.

    An operation is ``rejected`` as a whole if its canonical memory is unknown, not active or merged
    itself, if a duplicate is unknown, merged, in another space or the canonical memory, if an
    expected revision is not the current one, or if there are more than MOST_DUPLICATES. Of
    operations that share a duplicate, or of which one's canonical is another's duplicate, the
    first is ``applied``, the others are ``rejected``.
    """
    moved = redirects.select(F.col("source_memory_id").alias("memory_id")).distinct().withColumn("merged", F.lit(True))
    facts = (
        memories.dropDuplicates(["id"]).select(F.col("id").alias("memory_id"), "space_id", "state")
        .join(heads.select("memory_id", F.col("id").alias("head")), "memory_id", "left").join(moved, "memory_id", "left")
    )
    side = lambda name: facts.select(*[F.col(c).alias(f"{name}_{c}" if c != "memory_id" else f"{name}_id") for c in facts.columns])
    once = members.dropDuplicates(["operation_id", "duplicate_id", "duplicate_revision_id"])
    known = once.join(side("canonical"), "canonical_id", "left").join(side("duplicate"), "duplicate_id", "left")
    sound = (
        (F.col("canonical_state") == "active") & F.col("canonical_merged").isNull() & F.col("duplicate_merged").isNull() & (F.col("duplicate_id") != F.col("canonical_id"))
        & (F.col("canonical_space_id") == F.col("duplicate_space_id")) & (F.col("canonical_head") == F.col("canonical_revision_id")) & (F.col("duplicate_head") == F.col("duplicate_revision_id"))
    )
    own = Window.partitionBy("operation_id")
    judged = known.withColumn("_sound", F.min(F.coalesce(sound, F.lit(False)).cast("int")).over(own) * (F.count(F.lit(1)).over(own) <= MOST_DUPLICATES).cast("int"))
    # Every memory an operation needs, as a duplicate or as its canonical, is taken by the first one.
    uses = judged.filter("_sound = 1").select("operation_id", "arrival", F.explode(F.array(F.struct(F.col("duplicate_id").alias("m"), F.lit(True).alias("d")), F.struct(F.col("canonical_id").alias("m"), F.lit(False).alias("d")))).alias("u"))
    uses = uses.select("operation_id", "arrival", "u.m", "u.d").distinct()
    ends = Window.partitionBy("m").orderBy("arrival", "operation_id").rowsBetween(Window.unboundedPreceding, -1)
    late = uses.withColumn("_before", F.max(F.col("d").cast("int")).over(ends)).withColumn("_used", F.count(F.lit(1)).over(ends))
    blocked = late.filter((F.col("_before") == 1) | (F.col("d") & (F.col("_used") > 0))).select("operation_id").distinct().withColumn("_blocked", F.lit(True))
    outcome = F.when((F.col("_sound") == 1) & F.col("_blocked").isNull(), "applied").otherwise("rejected")
    return judged.join(blocked, "operation_id", "left").withColumn("outcome", outcome).select(*members.columns, F.col("duplicate_state"), "outcome")


def merge_rows(merged: DataFrame, redirects: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """What applied merges append: redirects of the duplicates and, so that paths stay short, of what
    was redirected to them; and an archiving event for each duplicate that was active, later than all
    events of the operation's duplicates."""
    done = merged.filter("outcome = 'applied'")
    now = done.join(events.groupBy(F.col("memory_id").alias("duplicate_id")).agg(F.max("recorded_at").alias("_last"), F.max("event_number").alias("_number")), "duplicate_id", "left")
    last = F.max("_last").over(Window.partitionBy("operation_id"))
    now = now.withColumn("at", F.greatest("arrival", last + F.expr("INTERVAL 1 MILLISECOND")))
    direct = now.select(F.col("duplicate_id").alias("source_memory_id"), F.col("canonical_id").alias("canonical_memory_id"), "operation_id", F.lit(True).alias("direct"), F.col("at").alias("created_at"))
    heirs = latest_redirects(redirects).select("source_memory_id", F.col("canonical_memory_id").alias("duplicate_id"))
    inherited = heirs.join(now, "duplicate_id").select("source_memory_id", F.col("canonical_id").alias("canonical_memory_id"), "operation_id", F.lit(False).alias("direct"), F.col("at").alias("created_at"))
    archived = now.filter("duplicate_state = 'active'").select(F.col("duplicate_id").alias("memory_id"), (F.coalesce("_number", F.lit(0)) + 1).alias("event_number"), F.lit("archived").alias("state"), F.col("at").alias("recorded_at"))
    return {"redirects": direct.unionByName(inherited).withColumn("id", new_id("operation_id", "source_memory_id")), "events": archived}


#: Where a memory's id stands in each table that a deletion clears; of two columns either one counts.
CASCADE = {
    "memories": ["id"], "revisions": ["memory_id"], "events": ["memory_id"], "segments": ["memory_id"], "vectors": ["memory_id"], "links": ["src", "dst"], "feedback": ["memory_id"],
    "redirects": ["source_memory_id", "canonical_memory_id"], "merge_members": ["duplicate_memory_id"], "merge_operations": ["canonical_memory_id"], "jobs": ["memory_id"], "tags": ["memory_id"], "sources": ["memory_id"],
}


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to the memories in ``gone`` (memory_id): one anti join per
    key; merge operations that no member is left of leave as well."""
    ids = gone.select("memory_id").filter("memory_id IS NOT NULL").distinct()
    left = {}
    for name, df in tables.items():
        for key in CASCADE[name]:
            df = df.join(ids.select(F.col("memory_id").alias(key)), key, "left_anti")
        left[name] = df
    if "merge_operations" in left and "merge_members" in left:
        left["merge_operations"] = left["merge_operations"].join(left["merge_members"].select(F.col("operation_id").alias("id")).distinct(), "id", "left_semi")
    return left


def claim(jobs: DataFrame, now: str, most: int) -> DataFrame:
    """The next ``most`` jobs (id, status, attempts, created_at, updated_at) to run: pending ones and
    those whose lease has run out, oldest first, as running with one more attempt."""
    at = instant(now)
    stale = (F.col("status") == "running") & (F.col("updated_at") < at - F.expr(LEASE))
    free = jobs.filter(((F.col("status") == "pending") | stale) & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("created_at", "id").limit(most)
    return free.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "updated_at": at})


def finish(jobs: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Running jobs after ``results`` (id, error): complete without error; with one, pending again
    until the attempts are used up, then failed. One job's failure touches no other."""
    joined = jobs.filter("status = 'running'").join(results.select("id", "error", F.lit(True).alias("_ended")), "id")
    status = F.when(F.col("error").isNull(), "complete").when(F.col("attempts") < MOST_ATTEMPTS, "pending").otherwise("failed")
    return joined.withColumns({"status": status, "updated_at": instant(now)}).drop("_ended")


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs of each generation: all, and how many are in which state."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.groupBy("generation_id").agg(F.count(F.lit(1)).alias("total"), *[count(s) for s in ("pending", "running", "complete", "failed")])


def index_status(memories: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, index_status) after the last job of each memory's current revision; the time a memory
    was updated does not change."""
    last = latest(jobs, ["revision_id"], [F.desc("updated_at"), F.desc("id")]).select(F.col("revision_id").alias("current_revision_id"), F.col("status").alias("_s"))
    shown = F.when(F.col("_s") == "complete", "ready").when(F.col("_s") == "failed", "failed").when(F.col("_s").isNotNull(), "pending").otherwise(F.col("index_status"))
    return memories.join(last, "current_revision_id", "left").select("id", shown.alias("index_status"))
