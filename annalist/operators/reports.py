"""Reports, decisions on proposals, trust, and notes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import days_between, trust_tier


def ops_stats(edges: DataFrame) -> DataFrame:
    """A2: edges of each type, and how many of them are open."""
    return edges.groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("invalid_at").isNull()).alias("open"))


def owner_report(runs: DataFrame, served: DataFrame) -> DataFrame:
    """A5: per owner runs by result, successes and stalls per 100 runs, tokens, and runs that memory served."""
    met = runs.join(served.select("run_id").distinct().withColumn("_served", F.lit(True)), "run_id", "left")
    won, stalled = F.col("run_result") == "success", F.col("run_result") == "max_turns"
    rate = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 2)
    return met.groupBy("org_id").agg(F.count("*").alias("n_runs"), rate(won).alias("won_per_100"), rate(stalled).alias("stalled_per_100"), F.round(F.sum("tokens"), 3).alias("tokens"), F.count("_served").alias("n_served"))


def distillation_window(runs: DataFrame, turns: DataFrame, now: Column, days: int = 14, skip: int = 1) -> DataFrame:
    """Runs since a tenant's last scored turn, or else of the last ``days``; without the ``skip`` earliest of each tenant."""
    last = turns.groupBy("org_id").agg(F.max("at").alias("_last"))
    since = F.coalesce("_last", now - F.make_interval(days=F.lit(days)))
    kept = runs.join(last, "org_id", "left").where(F.col("at") > since).drop("_last")
    order = Window.partitionBy("org_id").orderBy("at", "run_id")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > skip).drop("_n")


def applicability(proposals: DataFrame, tunables: DataFrame) -> DataFrame:
    """Unknown, locked, out_of_range, not_allowed or applicable, by the range, set and lock of what is to be tuned."""
    met = proposals.join(tunables, ["hop", "knob"], "left")
    number = F.col("value").try_cast("double")
    out = F.col("low").isNotNull() & (number.isNull() | (number < F.col("low")) | (number > F.col("high")))
    verdict = (
        F.when(F.col("locked").isNull(), "unknown").when(F.col("locked"), "locked").when(out, "out_of_range")
        .when(F.col("choices").isNotNull() & ~F.array_contains("choices", F.col("value")), "not_allowed").otherwise("applicable")
    )
    return met.withColumn("applicability", verdict).drop("low", "high", "choices", "locked")


def promotion_gate(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Auto where the verdict is accepted by a gating golden and no tool can apply changes; unknown tools count as able to."""
    tools = candidates.select("candidate_id", F.explode_outer("tools").alias("tool")).join(manifest.select("tool", "applies"), "tool", "left")
    able = tools.groupBy("candidate_id").agg(F.bool_or(F.col("tool").isNotNull() & F.coalesce("applies", F.lit(True))).alias("apply_capable"))
    met = candidates.join(able, "candidate_id")
    return met.withColumn("gate", F.when((F.col("verdict") == "accepted") & F.col("gating") & ~F.col("apply_capable"), "auto").when(F.col("verdict") == "accepted", "review").otherwise("rejected"))


def cited_proposals(proposals: DataFrame, read: DataFrame) -> DataFrame:
    """Proposals all of whose evidence was read."""
    each = proposals.select("proposal_id", F.explode("evidence").alias("evidence_id"))
    unread = each.join(read.select("evidence_id").distinct(), "evidence_id", "left_anti").select("proposal_id").distinct()
    return proposals.join(unread, "proposal_id", "left_anti")


def eval_verdict(results: DataFrame, gates: DataFrame) -> DataFrame:
    """Per candidate the pass rate of each suite in order; the first under its floor rejects and later ones are skipped."""
    rates = results.groupBy("candidate_id", "suite").agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("rate")).join(gates, "suite")
    before = Window.partitionBy("candidate_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("rate") < F.col("floor")
    earlier = F.coalesce(F.max(failed.cast("int")).over(before), F.lit(0))
    return rates.withColumn("outcome", F.when(earlier == 1, "skipped").when(failed, "rejected").otherwise("passed")).select("candidate_id", "suite", "position", "rate", "outcome")


def verdict_episodes(verdicts: DataFrame) -> DataFrame:
    """One ledger row for each candidate: adopted unless a suite rejected it."""
    per = verdicts.groupBy("candidate_id").agg(F.bool_or(F.col("outcome") == "rejected").alias("_no"))
    return per.select(F.concat(F.lit("eval:"), "candidate_id").alias("event_id"), F.lit("hop.eval_scored").alias("action_type"), F.when(F.col("_no"), "rejected").otherwise("adopted").alias("decision"))


def survival(last_seen: Column, half_life: Column, now: Column) -> Column:
    """days since the last observation, and that in half-lives."""
    age = F.greatest(days_between(now, last_seen), F.lit(0.0))
    return F.when(last_seen.isNotNull(), F.struct(F.round(age, 2).alias("age_days"), F.round(age / half_life, 2).alias("half_lives"), (age > half_life).alias("decayed")))


def trust_records(nodes: DataFrame, consequences: DataFrame, now: Column) -> DataFrame:
    """each node's tier with the signals it comes from."""
    met = nodes.join(consequences, "node_id", "left").fillna(0, ["passes", "fails", "runs"])
    tier = trust_tier(F.col("endorsed"), F.col("grounded"), F.col("observed"), F.col("passes"), F.col("fails"))
    return met.select("node_id", tier.alias("tier"), "grounded", "observed", "passes", "fails", "runs", survival(F.col("last_seen"), F.col("half_life"), now).alias("survival"))


def served_verdicts(served: DataFrame, verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, run_id, run_result): nodes served in a run, or derived from events injected into it, with its verdict."""
    direct = served.select("run_id", F.explode("node_ids").alias("node_id"))
    source = nodes.select("node_id", F.explode("derived_from").alias("event_id"))
    injected = served.select("run_id", F.explode("event_ids").alias("event_id")).join(source, "event_id").select("run_id", "node_id")
    return direct.unionByName(injected).distinct().join(verdicts.select("run_id", "run_result"), "run_id")


def changed_sections(versions: DataFrame) -> DataFrame:
    """(note_id, version, section, change): sections of a version against the one before: added, changed or removed."""
    order = Window.partitionBy("note_id").orderBy("version")
    pairs = versions.withColumn("_before", F.lag("sections").over(order)).where(F.col("_before").isNotNull())
    each = pairs.select("note_id", "version", "sections", "_before", F.explode(F.array_union(F.map_keys("sections"), F.map_keys("_before"))).alias("section"))
    now, was = F.col("sections")[F.col("section")], F.col("_before")[F.col("section")]
    change = F.when(was.isNull(), "added").when(now.isNull(), "removed").when(now != was, "changed")
    return each.withColumn("change", change).where("change is not null").select("note_id", "version", "section", "change")


def visible_notes(notes: DataFrame, user: str, units: list[str]) -> DataFrame:
    """Notes of the org, the caller's own, and of units the caller is in, by scope and workspace."""
    mine = (F.col("scope") == "org") | ((F.col("scope") == "user") & (F.col("scope_id") == user)) | ((F.col("scope") == "team") & F.col("scope_id").isin(*units))
    return notes.where(mine).orderBy("scope", "workspace", "note_id")


def close_threads(bullets: DataFrame, stale: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Bullets with a flag: closed where every citation is stale; run pointers are stale when old or missing.

    ``bullets``: note_id, bullet, citations (kind, id, at).
    """
    each = bullets.select("note_id", "bullet", F.explode("citations").alias("c")).select("note_id", "bullet", "c.*")
    old = F.col("at").isNull() | (F.col("at") < now - F.make_interval(days=F.lit(days)))
    # a run's pointer is judged by its time: many may have one id, and none is met by it
    is_run = F.coalesce(F.col("kind") == "run", F.lit(False))
    runs = each.where(is_run).select("note_id", "bullet", old.alias("_over"))
    gone = each.where(~is_run).join(stale.select("id").distinct().withColumn("_stale", F.lit(True)), "id", "left")
    closed = runs.unionByName(gone.select("note_id", "bullet", F.col("_stale").isNotNull().alias("_over"))).groupBy("note_id", "bullet").agg(F.bool_and("_over").alias("closed"))
    return bullets.join(closed, ["note_id", "bullet"], "left").fillna(False, ["closed"])


def state_block(notes: DataFrame, topics: DataFrame, most: int = 12, start: str = "<!-- state -->", end: str = "<!-- /state -->") -> DataFrame:
    """The lines between the markers replaced by the newest line of each topic, newest first, at most ``most``."""
    newest = topics.groupBy("note_id", "topic").agg(F.max(F.struct("at", "line")).alias("x")).select("note_id", "topic", "x.at", "x.line")
    order = Window.partitionBy("note_id").orderBy(F.desc("at"), "topic")
    kept = newest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    block = kept.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "line").alias("line")))), lambda x: x["line"]), "\n").alias("_block"))
    pattern = rf"(?s){start}.*?{end}"
    met = notes.join(block, "note_id", "left")
    new = F.concat(F.lit(start + "\n"), F.coalesce("_block", F.lit("")), F.lit("\n" + end))
    # $ and \ of a line stand for themselves
    plain = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return met.withColumn("body", F.regexp_replace(F.col("body"), F.lit(pattern), plain)).drop("_block")


def gold_hit(answers: DataFrame, items: DataFrame) -> DataFrame:
    """V4: does any item of a question hold its gold answer, both normalized?"""
    from annalist.operators.evaluate import normalize_answer

    met = answers.select("query_id", normalize_answer(F.col("gold")).alias("_gold")).join(items.select("query_id", normalize_answer(F.col("content")).alias("_text")), "query_id", "left")
    held = F.coalesce((F.col("_gold") != "") & F.contains(F.col("_text"), F.col("_gold")), F.lit(False))
    return met.groupBy("query_id").agg(F.bool_or(held).alias("gold_hit"))


def run_summary(rows: DataFrame) -> DataFrame:
    """V5: per type questions, accuracy, mean recall, latency at its nearest 95 %, and ingest counted once for a haystack."""
    n = F.count("*")
    ordered = F.array_sort(F.collect_list("latency_ms"))
    per = rows.groupBy("type").agg(n.alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("recall"), 6).alias("recall"), F.get(ordered, F.floor(0.95 * (F.size(ordered) - 1)).cast("int")).alias("p95_ms"))
    once = rows.groupBy("type", "haystack").agg(F.max("ingested_chars").alias("_chars")).groupBy("type").agg(F.sum("_chars").alias("ingested_chars"))
    return per.join(once, "type")
