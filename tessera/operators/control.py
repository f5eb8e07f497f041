"""Rules of a working node as columns and small tables: tasks, schedules, populations, gates, signals, capabilities, processes.

Null means "not measured" throughout, and is neither true nor false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.steps import Steps

#: Seconds: a lease, the longest pause, a gate's slowest round and its timeout, the least pause between syncs.
LEASE, LONGEST_PAUSE, SLOWEST, TIMEOUT, LEAST_SYNC = 120, 300, 900, 1800, 1.0
MOST_ATTEMPTS, WINDOW = 5, 24


# --- tasks


def claims(tasks: DataFrame, workers: DataFrame, window: int = WINDOW) -> DataFrame:
    """(worker, id): which pending task each worker takes. tasks (id, status, priority, attempts, since); workers (worker).

    All look at the same window of pending tasks, each in an order of its own; a
    task goes to the first that asks for it, and a worker that is beaten to all
    its first choices goes without in this round.
    """
    open_ = tasks.filter((F.col("status") == "pending") & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("priority", "since", "id").limit(window).select("id")
    asks = workers.crossJoin(F.broadcast(open_)).withColumn("order", F.md5(F.concat_ws("|", "worker", "id").cast("binary")))
    first = W.partitionBy("worker").orderBy("order", "id")
    wanted = asks.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    won = W.partitionBy("id").orderBy("order", "worker")
    return wanted.withColumn("won", F.row_number().over(won)).filter("won = 1").select("worker", "id")


def lease(status: Column, age_s: Column, attempts: Column) -> tuple[Column, Column]:
    """(verdict, pause): a claim within its lease is kept, a stale one retried after a growing pause, or dead at the most attempts."""
    verdict = F.when(status != "claimed", F.lit(None)).when(age_s <= LEASE, "kept").when(attempts >= MOST_ATTEMPTS, "dead").otherwise("retry")
    return verdict, F.when(verdict == "retry", F.least(F.lit(LONGEST_PAUSE), 15 * attempts))


def transition(status: Column, verb: Column, owner: Column, caller: Column) -> Column:
    """The status of a task after a verb: claim a pending one, renew, release or complete one's own; anything else changes nothing."""
    mine = (status == "claimed") & owner.eqNullSafe(caller)
    return (
        F.when((verb == "claim") & (status == "pending"), "claimed").when((verb == "renew") & mine, "claimed").when((verb == "release") & mine, "pending")
        .when((verb == "complete") & mine, "done").otherwise(status)
    )


def outcome(result: Column) -> Column:
    """failed for a result that has an error at its top and no operator, unreadable for no JSON object, else done."""
    readable = F.try_parse_json(result).isNotNull() & F.trim(result).startswith("{")
    return F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(
        F.get_json_object(result, "$.error").isNotNull() & F.get_json_object(result, "$.operator").isNull(), "failed"
    ).otherwise("done")


def fleet(backlog: Column, per_worker: Column, cap: Column) -> Column:
    """Workers wanted: one for every per_worker tasks, up to cap; none for no backlog, null for an unmeasured one."""
    return F.when(backlog.isNotNull(), F.least(cap, F.ceil(F.greatest(backlog, F.lit(0)) / per_worker)).cast("long"))


def scheduled(shards: DataFrame, done: DataFrame, recurring: DataFrame, queued: DataFrame, now: Column) -> DataFrame:
    """(key, operator) to enqueue: a task for every shard not done, and every recurring operator whose pause is over; none that is queued already.

    shards (shard, operator); done (shard); recurring (operator, last, every_s), last null for never; queued (key).
    """
    shard_tasks = shards.join(done, "shard", "left_anti").select(F.concat_ws(":", "operator", "shard").alias("key"), "operator")
    due = F.col("last").isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) >= F.col("every_s").cast("long") * 1_000_000)
    return shard_tasks.unionByName(recurring.filter(due).select(F.col("operator").alias("key"), "operator")).join(queued.select("key"), "key", "left_anti")


def curriculum(stages: DataFrame) -> DataFrame:
    """(nth, stage, state) of stages (nth, stage, have, target, exhausted, shards_left): done ones are promoted, the first of the others is worked on, the rest wait.

    Done: the target is reached, the source is exhausted, or no shard is left. A stage without a count is not done.
    """
    done = F.coalesce(F.col("have") >= F.col("target"), F.lit(False)) | F.coalesce(F.col("exhausted"), F.lit(False)) | F.coalesce(F.col("shards_left") == 0, F.lit(False))
    marked = stages.withColumn("done", done)
    first = marked.filter("NOT done").agg(F.min("nth").alias("first"))
    return marked.crossJoin(F.broadcast(first)).select("nth", "stage", F.when(F.col("done"), "promoted").when(F.col("nth") == F.col("first"), "current").otherwise("waiting").alias("state"))


#: Ordered stages of an ingest: (stage, source, target rows).
STAGES = (("lexicon", "lmf", 100_000), ("pivots", "concept_lines", 100_000), ("assertions", "assertions", 1_000_000), ("encyclopedia", "dump", 200_000), ("web", "shards", None))


def due(tick: Column, every: Column) -> Column:
    """A cadence of every ticks; none for 0 or less."""
    return F.when(every > 0, F.pmod(tick, F.when(every > 0, every).otherwise(1)) == 0).otherwise(False)


def sync_pause(wanted: Column) -> Column:
    return F.greatest(wanted, F.lit(LEAST_SYNC))


# --- population, drain, gates, health


def bred(energy: Column, cost: Column, mass: Column, verified: Column, headroom: Column, floor: float = 1.0) -> Column:
    """die under floor times the cost; breed with twice the cost, mass, a verified result and a quarter of headroom; else sustain. Null energy decides nothing."""
    able = (energy >= 2 * cost) & (mass > 0) & (verified >= 1) & (headroom >= 0.25)
    return F.when(energy.isNull(), None).when(energy < floor * cost, "die").when(F.coalesce(able, F.lit(False)), "breed").otherwise("sustain")


def inherited(child: Column, stated: Column, parent: Column, author: Column) -> Column:
    """Whether a child structure is accepted: its hash is the stated one, it differs from its parent, and someone answers for it."""
    actual = F.sha2(child.cast("binary"), 256)
    return F.when(author.isNull() | (author == ""), "unattributed").when(actual != stated, "hash mismatch").when(child == parent, "identical").otherwise("accepted")


def drained(exhausted: Column, backfilled: Column, backlog: Column) -> Column:
    """Done only if the source is exhausted, the backfill is through and the backlog is 0 or unmeasured."""
    return F.coalesce(exhausted, F.lit(False)) & F.coalesce(backfilled, F.lit(False)) & F.coalesce(backlog == 0, F.lit(True))


def gate(age_s: Column, open_: Column) -> Column:
    """A published gate counts while it is fresh; a stale or missing one says nothing."""
    return F.when(age_s < SLOWEST + TIMEOUT, open_)


def health(gate_: Column, missing: Column, anomalies: Column, errors: Column) -> Column:
    """Reasons why a node is not well, none for a healthy one."""
    reasons = (
        F.when(gate_.isNull(), "gate unknown").when(~gate_, "gate closed"), F.when(missing > 0, "provenance incomplete"),
        F.when(anomalies > 0, "anomalies"), F.when(errors > 0, "worker errors"),
    )
    return F.array_compact(F.array(*reasons))


def envelope(free: Column, floor: Column, evictable: Column) -> tuple[Column, Column]:
    """(shortfall, eviction): what is missing below a floor, and how much of it can be evicted."""
    shortfall = F.greatest(F.lit(0.0), floor - free)
    return shortfall, F.least(shortfall, evictable)


def progress(have: Column, target: Column) -> Column:
    return F.when(target > 0, F.least(F.lit(1.0), have / target))


def silent(last: Column, now: Column, interval_s: float) -> Column:
    """Silence over four intervals, an interval counting twenty seconds at most."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) > F.lit(int(4 * min(interval_s, 20) * 1_000_000))


def newest_first(new: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """(kind, n): rows that are new to a store, and rows that were applied again; a source's health goes by the new ones."""
    fresh = new.select(*fields).exceptAll(stored.select(*fields))
    n, total = fresh.agg(F.count(F.lit(1)).alias("new")), new.agg(F.count(F.lit(1)).alias("all"))
    both = n.crossJoin(total).select(F.array(F.struct(F.lit("new").alias("kind"), F.col("new").alias("n")), F.struct(F.lit("reapplied").alias("kind"), (F.col("all") - F.col("new")).alias("n"))).alias("a"))
    return both.select(F.explode("a").alias("r")).select("r.kind", "r.n")


# --- signals


def signature(key: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws("\n", key, F.to_json(F.struct(*fields))).cast("binary"), 256)


def verified(stated_id: Column, actual_id: Column, signed: Column, key: Column, expected: Column) -> Column:
    """ok, or why a signal is not believed: unsigned, no key, bad signature, id mismatch."""
    return (
        F.when(signed.isNull(), "unsigned").when(key.isNull(), "no key").when(signed != expected, "bad signature").when(stated_id != actual_id, "id mismatch").otherwise("ok")
    )


def standing(claimed: Column, rungs: tuple[str, ...]) -> Column:
    """The rung of a claim; an unknown one is a hypothesis."""
    return F.when(claimed.isin(*rungs), claimed).otherwise("hypothesis")


def routed(signals: DataFrame) -> DataFrame:
    """(id, verdict, channel, regime, stands_beside) of signals (id, verdict, authorised, authenticated, about): only what is believed and authorised goes on; an event says how many others are about the same."""
    verdict = F.when(F.col("verdict") != "ok", F.col("verdict")).when(~F.coalesce("authorised", F.lit(False)), "unauthorised").otherwise("delivered")
    on = signals.withColumn("verdict", verdict)
    believed = F.sum((F.col("verdict") == "delivered").cast("long")).over(W.partitionBy("about"))
    regime = F.when(F.col("verdict") == "delivered", F.when(F.col("about").isNotNull(), "EVENT").otherwise("MESSAGE"))
    channel = F.when(F.col("authenticated"), "SYSTEM").otherwise("CLIENT")
    return on.withColumn("beside", believed).select("id", "verdict", channel.alias("channel"), regime.alias("regime"), F.when(regime == "EVENT", F.col("beside") - 1).alias("stands_beside"))


# --- capabilities and hosts


def offered(capabilities: DataFrame, overrides: DataFrame) -> DataFrame:
    """(host, offers, unknown, absent): names by their three values, a declared override taking the place of a probe. capabilities, overrides (host, name, present)."""
    said = overrides.select("host", "name", F.col("present").alias("stated"), F.lit(True).alias("overridden"))
    all_ = capabilities.join(said, ["host", "name"], "full").withColumn("value", F.when(F.col("overridden"), F.col("stated")).otherwise(F.col("present")))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    return all_.groupBy("host").agg(names(F.col("value")).alias("offers"), names(F.col("value").isNull()).alias("unknown"), names(~F.col("value")).alias("absent"))


def slug(name: Column) -> Column:
    """a-z, 0-9 and single hyphens, 64 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 64)


def remote_operators(hosts: DataFrame) -> DataFrame:
    """(id, host, state) of hosts (host, operators array): what others offer, as pointers that nothing here runs."""
    each = hosts.select("host", F.explode("operators").alias("op"))
    return each.select(F.concat_ws(".", F.lit("op.host"), slug(F.col("host")), slug(F.col("op"))).alias("id"), "host", F.lit("inert").alias("state")).distinct()


def console(hosts: DataFrame, operators: DataFrame, most_hosts: int = 50, most_operators: int = 200) -> DataFrame:
    """(host, n, operators): the first hosts with the first of their operators; a host without any is shown too. hosts (host); operators (host, operator)."""
    shown = hosts.select("host").orderBy("host").limit(most_hosts)
    nth = F.row_number().over(W.partitionBy("host").orderBy("operator"))
    some = operators.join(F.broadcast(shown), "host", "left_semi").withColumn("nth", nth)
    listed = some.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most_operators, F.col("operator")))).alias("operators"))
    return shown.join(listed, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("operators", F.array().cast("array<string>")).alias("operators"))


def safe_path(path: Column) -> Column:
    """A relative path that does not leave its folder."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "[/\\\\]"), lambda p: p == "..") & (F.length(path) > 0) & ~path.contains("\u0000")


#: What a control request may ask for: (word, operator); the first word that occurs decides.
INTENTS = (("status", "op.status"), ("health", "op.health"), ("reindex", "op.reindex"), ("ingest", "op.ingest"), ("consolidate", "op.consolidate"), ("measure", "op.measure"))


def intent(text: Column) -> Column:
    """The operator that a control request names; null where it names none."""
    low = F.lower(text)
    return reduce(lambda out, x: out.when(low.rlike(rf"\b{x[0]}\b"), x[1]), INTENTS[1:], F.when(low.rlike(rf"\b{INTENTS[0][0]}\b"), INTENTS[0][1]))


def last_lines(log: DataFrame, key: str, order: str, line: str, matching: Column) -> DataFrame:
    """(key, line): of every key its last line that matches; keys without one are not published."""
    return log.filter(matching).groupBy(key).agg(F.max_by(line, order).alias("line"))


# --- processes


def processes_run(routes: DataFrame, answers: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """(case, path, ended): every case from step to step. routes (step, answer, to), answer null for the default; answers (case, step, answer).

    A step's answer takes its route, else the default one; without either the case
    ends there. Coming back to a step ends it too, as does the most steps.
    """
    steps = Steps(answers.sparkSession)
    to = routes.select(F.col("step").alias("at"), F.col("answer").alias("said"), "to")
    named, default = to.filter("said IS NOT NULL"), to.filter("said IS NULL").select("at", F.col("to").alias("default"))
    said = answers.select("case", F.col("step").alias("at"), F.col("answer").alias("said"))
    now = steps.written(answers.select("case").distinct().withColumns({"at": F.lit(start), "path": F.array(F.lit(start)), "ended": F.lit(None).cast("string")}), "cases")
    for _ in range(most):
        if now.filter("ended IS NULL").limit(1).count() == 0:
            break
        met = now.join(said, ["case", "at"], "left").join(named, ["at", "said"], "left").join(default, "at", "left")
        target = F.coalesce("to", "default")
        ended = F.coalesce("ended", F.when(target.isNull(), "end").when(F.array_contains("path", target), "cycle"))
        goes = F.col("ended").isNull() & target.isNotNull() & ~F.array_contains("path", target)
        now = steps.written(
            met.select("case", F.when(goes, target).otherwise(F.col("at")).alias("at"), F.when(goes, F.concat("path", F.array(target))).otherwise(F.col("path")).alias("path"), ended.alias("ended")), "cases"
        )
    out = now.select("case", F.array_join("path", ">").alias("path"), F.coalesce("ended", F.lit("limit")).alias("ended"))
    steps.over(now)
    return out


# --- counts that are not taken anew at every look


def served_counts(names: DataFrame, readings: DataFrame, now: Column, ttl: float, keep_stale: bool) -> DataFrame:
    """(name, n, age, fresh): the last reading of every name, without counting anything. names (name); readings (name, n, at).

    Fresh if it is no older than ttl seconds. An older one is still served with
    keep_stale and else is null, as is a name that was never counted (its age and
    freshness too): not measured is not 0. Of readings at one time the greatest
    count serves; readings of no time or after now are none.
    """
    age = now.cast("double") - F.col("at").cast("double")
    last = readings.select("name", "n", age.alias("age")).filter("age >= 0").groupBy("name").agg(F.max(F.struct((-F.col("age")).alias("since"), "n")).alias("m"))
    held = last.select(F.col("name").alias("of"), -F.col("m.since") + F.lit(0.0), F.col("m.n").alias("held")).toDF("of", "age", "held")
    fresh = F.col("age") <= ttl
    n = F.col("held") if keep_stale else F.when(fresh, F.col("held"))
    return names.select("name").distinct().join(held, F.col("name") == F.col("of"), "left").select("name", n.alias("n"), "age", fresh.alias("fresh"))


def due_counts(served: DataFrame) -> DataFrame:
    """(name): what a pass that may scan should count again."""
    return served.filter(~F.coalesce("fresh", F.lit(False))).select("name")
