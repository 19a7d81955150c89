"""Traversals and hierarchies as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import micros
from annalist.functions.text import NEGATIONS
from annalist.sources.shared import keep


def doubled(edges: DataFrame) -> DataFrame:
    """Undirected: each edge from both ends, loops left out."""
    pairs = edges.select("src_id", "dst_id").where("src_id <> dst_id")
    return pairs.unionByName(pairs.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()


def hops(starts: DataFrame, edges: DataFrame, depth: int = 3, fan_out: int | None = None) -> DataFrame:
    """(query_id, node_id, hops): nodes within ``depth`` steps and their least distance.

    A step joins the frontier to the edges and drops what is known; ``fan_out``
    keeps that many new nodes of a query in a step, the least ids first.  Edges
    and each frontier are written once, so no step computes another again.
    """
    both = keep(doubled(edges))
    frontier = starts.select("query_id", "node_id").distinct()
    known = frontier.withColumn("hops", F.lit(0))
    for step in range(1, depth + 1):
        reached = frontier.join(both, F.col("node_id") == F.col("src_id")).select("query_id", F.col("dst_id").alias("node_id")).distinct()
        fresh = reached.join(known.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        if fan_out is not None:
            order = Window.partitionBy("query_id").orderBy("node_id")
            fresh = fresh.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fan_out).drop("_n")
        frontier = keep(fresh) if step < depth else fresh
        known = known.unionByName(frontier.withColumn("hops", F.lit(step)))
    return known


def unit_closure(units: DataFrame) -> DataFrame:
    """(unit_id, ancestor_id, distance) of a single-parent tree, each unit its own ancestor at 0.

    Paths double in length each round until none is added, so a tree of any
    depth takes a few joins; units on a cycle have only the ancestors that come before it closes.
    """
    found = keep(units.select("unit_id", F.col("unit_id").alias("ancestor_id"), F.lit(0).alias("distance")).unionByName(
        units.where("parent_id is not null and parent_id <> unit_id").select("unit_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    ).distinct())
    reach = 1
    while True:
        far = found.where(F.col("distance") == reach)
        on = found.where("distance > 0").select(F.col("unit_id").alias("ancestor_id"), F.col("ancestor_id").alias("_up"), F.col("distance").alias("_more"))
        longer = far.join(on, "ancestor_id").select("unit_id", F.col("_up").alias("ancestor_id"), (F.col("distance") + F.col("_more")).alias("distance"))
        fresh = keep(longer.join(found, ["unit_id", "ancestor_id"], "left_anti").groupBy("unit_id", "ancestor_id").agg(F.min("distance").alias("distance")))
        if not fresh.limit(1).count():
            return found
        found, reach = found.unionByName(fresh), 2 * reach


def unit_access(closure: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """(user_id, unit_id, access): own units are written; an admin of a unit administers those below it and
    reads them where ``read_descendants`` says so."""
    below = members.join(closure.withColumnRenamed("unit_id", "below_id"), members["unit_id"] == closure["ancestor_id"])
    met = below.join(policies.select(F.col("unit_id").alias("ancestor_id"), "read_descendants"), "ancestor_id", "left")
    access = F.when(F.col("distance") == 0, "write").when((F.col("role") == "admin") & F.coalesce("read_descendants", F.lit(False)), "read").when(F.col("role") == "admin", "administer")
    rank = F.struct(F.when(access == "write", 3).when(access == "read", 2).otherwise(1), access)
    return met.where(access.isNotNull()).groupBy("user_id", F.col("below_id").alias("unit_id")).agg(F.max(rank).alias("r")).select("user_id", "unit_id", F.col("r.col2").alias("access"))


def validate_tree(units: DataFrame) -> DataFrame:
    """(unit_id, problem): equal names under one parent, missing parents, and units that reach no root."""
    twins = Window.partitionBy("parent_id", "name")
    same = units.withColumn("_n", F.count("*").over(twins)).where("_n > 1").select("unit_id", F.lit("duplicate_name").alias("problem"))
    orphan = units.where("parent_id is not null").join(units.select(F.col("unit_id").alias("parent_id")), "parent_id", "left_anti").select("unit_id", F.lit("missing_parent").alias("problem"))
    roots = units.where("parent_id is null").select(F.col("unit_id").alias("ancestor_id"))
    reach = unit_closure(units).join(roots, "ancestor_id").select("unit_id").distinct()
    lost = units.join(reach, "unit_id", "left_anti").select("unit_id", F.lit("no_root").alias("problem"))
    return same.unionByName(orphan).unionByName(lost)


def contested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with a flag: touched by an open CONTRADICTS edge?"""
    live = edges.where("type = 'CONTRADICTS' and invalid_at is null")
    ends = live.select(F.col("src_id").alias("node_id")).unionByName(live.select(F.col("dst_id").alias("node_id"))).distinct()
    return nodes.join(ends.withColumn("_hit", F.lit(True)), "node_id", "left").withColumn("contested", F.coalesce("_hit", F.lit(False))).drop("_hit")


def expand_values(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """T4: each anchor hit with its open value; anchors without one are dropped."""
    live = edges.where("type = 'HAS_VALUE' and invalid_at is null").select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("value_id"), "valid_at")
    return hits.join(live, "node_id")


def build_nodes(entities: DataFrame, key: list[str]) -> DataFrame:
    """B1, B2: one node for each identity: last non-empty name, first source, distinct provenance, observations counted."""
    order = F.struct("occurred_at", "event_id")
    named = F.when(F.col("name") != "", F.col("name"))
    return entities.groupBy(*key).agg(
        F.max_by(named, F.when(named.isNotNull(), order)).alias("name"), F.min_by("source", order).alias("source"), F.countDistinct("event_id").alias("observed_count"),
        F.array_sort(F.collect_set(F.col("event_id").cast("string"))).alias("derived_from"), F.max("occurred_at").alias("last_observed_at"),
        F.when(F.bool_or(F.col("status") == "committed"), "committed").otherwise("working").alias("status"),
    )


def end_entities(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Ended where the last word on an entity is absence, committed where it is presence; values are no entities."""
    last = targets.groupBy("key").agg(F.max_by("presence", F.struct("at", "presence")).alias("_last"))
    met = nodes.join(last, "key", "left")
    entity = ~F.col("type").isin("Metric", "MetricValue")
    status = F.when(entity & (F.col("_last") == "absent"), "ended").when(entity & (F.col("_last") == "present") & (F.col("status") == "ended"), "committed").otherwise(F.col("status"))
    return met.withColumn("status", status).drop("_last")


def resolve_alias(entities: DataFrame) -> DataFrame:
    """(key, canonical): names joined through aliases, however long the chain, share the least of them.

    Each round takes the least canonical name of a name's neighbours, then that
    name's own canonical one, so the steps double; it ends when nothing changes.
    """
    pairs = entities.select("key", F.explode_outer("aliases").alias("other")).where("other is not null")
    links = keep(pairs.select(F.col("key").alias("a"), F.col("other").alias("b")).unionByName(pairs.select(F.col("other").alias("a"), F.col("key").alias("b"))).distinct())
    best = keep(links.select(F.col("a").alias("key")).unionByName(entities.select("key")).distinct().withColumn("canonical", F.col("key")))
    while True:
        near = links.join(best.select(F.col("key").alias("b"), F.col("canonical").alias("_c")), "b").groupBy(F.col("a").alias("key")).agg(F.min("_c").alias("_n"))
        # what a name is told to follow tells its own least neighbour too
        told = near.join(best, "key").groupBy(F.col("canonical").alias("key")).agg(F.min("_n").alias("_t"))
        step = best.join(near, "key", "left").join(told, "key", "left").select("key", F.least("canonical", "_n", "_t").alias("_to"), F.col("canonical").alias("_was"))
        onward = step.select(F.col("key").alias("_to"), F.col("_to").alias("_next"))
        after = keep(step.join(onward, "_to", "left").select("key", F.least("_to", "_next").alias("canonical"), "_was"))
        best = after.select("key", "canonical")
        if not after.where("canonical <> _was").limit(1).count():
            return best


def invalidate_contradictions(edges: DataFrame, most: int = 5) -> DataFrame:
    """Open edges of one source and type whose statements contradict: the older is closed at the newer's start.

    Edges meet under every two words that they share, and only a negated one
    with one that is not, so whatever meets does contradict.  Under each two
    words a newer edge takes the last ``most`` of the other kind that began
    before it, by their numbers, and of those of all its words the last ``most``
    stay.  One identity (source, type, other end) has one open edge.
    """
    open_ = edges.where("invalid_at is null")
    denies = F.array(*map(F.lit, NEGATIONS))
    words = F.array_distinct(F.regexp_extract_all(F.lower("fact"), F.lit("[a-z0-9]+"), 0))
    told = open_.select("src_id", "type", "edge_id", F.col("dst_id").alias("dst"), "valid_at", F.arrays_overlap(words, denies).alias("denied"), F.array_sort(F.array_except(words, denies)).alias("w"))
    twos = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.concat_ws(" ", x, y))))
    each = told.select("src_id", "type", F.explode(twos).alias("two"), "edge_id", "dst", "valid_at", "denied")
    group = ("src_id", "type", "two")
    before = Window.partitionBy(*group).orderBy(micros(F.col("valid_at"))).rangeBetween(Window.unboundedPreceding, -1)
    other = F.coalesce(F.when(F.col("denied"), F.count_if(~F.col("denied")).over(before)).otherwise(F.count_if("denied").over(before)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*group, "denied").orderBy("valid_at", F.desc("edge_id")))
    placed = each.withColumn("n", nth.cast("long")).withColumn("other", other)
    last = F.sequence(F.greatest(F.col("other") - most, F.lit(1).cast("long")), F.col("other"))  # one more, as one may have the same other end
    newer = placed.where("other > 0").select(*group, (~F.col("denied")).alias("denied"), F.explode(last).alias("n"), F.col("edge_id").alias("_newer"), F.col("dst").alias("_dst"), F.col("valid_at").alias("_at"))
    met = placed.join(newer, [*group, "denied", "n"]).where(F.col("dst") != F.col("_dst")).select("edge_id", "valid_at", "_newer", "_at").distinct()
    order = Window.partitionBy("_newer").orderBy(F.desc("valid_at"), "edge_id")
    hit = met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).groupBy("edge_id").agg(F.min("_at").alias("_closed"))
    return edges.join(hit, "edge_id", "left").withColumn("invalid_at", F.coalesce("invalid_at", "_closed")).drop("_closed")


def lift(nodes: DataFrame, units: DataFrame, tiers: tuple[str, ...] = ("corroborated", "endorsed")) -> DataFrame:
    """Learnings of a unit at the named tiers copied one level up; once for equal content; none with personal data, none lifted before."""
    from annalist.functions.text import pii_kinds

    up = nodes.join(units.select("unit_id", "parent_id").where("parent_id is not null"), "unit_id")
    clean = up.where(F.col("tier").isin(*tiers) & ~F.coalesce("lifted", F.lit(False)) & (F.size(pii_kinds(F.col("name"))) == 0))
    new = clean.groupBy(F.col("parent_id").alias("unit_id"), "name").agg(F.max("tier").alias("tier"), F.count("*").alias("observed_count")).withColumn("lifted", F.lit(True))
    return new.join(nodes.select("unit_id", "name"), ["unit_id", "name"], "left_anti")


def build_registry(registrations: DataFrame) -> DataFrame:
    """The last known version, owner and mode of each hop; its contract is the last one."""
    order = Window.partitionBy("org_id", "name").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = [F.last(c, ignorenulls=True).over(order).alias(c) for c in ("version", "owner", "mode")]
    return registrations.select("org_id", "name", *kept, F.last("contract").over(order).alias("contract")).distinct()


def current_values(edges: DataFrame, prefixes: list[str]) -> DataFrame:
    """T5: open values under key prefixes, newest first."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("anchor_key").startswith(p)
    return edges.where(wanted & F.col("invalid_at").isNull()).orderBy(F.desc("valid_at"), "anchor_key")


def inject_values(queries: DataFrame, anchors: DataFrame, least: int = 2) -> DataFrame:
    """Anchors that share ``least`` tokens or more with a question, with score 1."""
    from annalist.functions.text import tokens
    from annalist.operators.classes import pairs_by_words

    words = anchors.select(F.col("anchor_id").alias("_id"), F.array_distinct(F.filter(F.split(F.lower("anchor_key"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)).alias("_words"))
    met = pairs_by_words(queries.select("query_id", tokens(F.col("question")).alias("_words")), words, F.col("_both") >= least)
    return met.select("query_id", F.col("_id").alias("anchor_id"), F.col("_both").alias("overlap"), F.lit(1.0).alias("score"))


def latest_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the last decision on their (base hop, turn), pending without one."""
    from annalist.functions.text import hop_base

    last = decisions.withColumn("base", hop_base(F.col("hop"))).groupBy("base", "turn").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    return proposals.withColumn("base", hop_base(F.col("hop"))).join(last, ["base", "turn"], "left").fillna("pending", ["decision"])
