"""What a builder is told before the first step: state, learnings, scored versions, deviations and runs of a hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import hop_base
from annalist.operators.retrieve import small
from annalist.sources.shared import keep

#: Facts of the company and of the fleet that are told.
COMPANY, FLEET = 15, 10


def prefixes(text: Column) -> Column:
    """All beginnings of a text, so that what begins with it can be met by equality."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda n: F.left(text, n))


def ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most)


def by_topics(hops: DataFrame, values: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State and learnings by (org_id, topics), as all hops of an organisation with equal topics have them, and the hops' topics."""
    build = hops.select("org_id", "hop", F.explode(F.filter("topics", lambda t: t["phase"] == "build")).alias("t"))
    named = build.select("org_id", "hop", F.regexp_replace(F.replace(F.col("t.id"), F.lit("{me}"), F.lit("")), r"\*+$", "").alias("topic")).where("topic <> ''")
    sets = named.groupBy("org_id", "hop").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    members = keep(hops.select("org_id", "hop").distinct().join(sets, ["org_id", "hop"], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>"))))
    groups = keep(members.select("org_id", "topics").distinct())
    topics = small(keep(groups.select("org_id", "topics", F.explode("topics").alias("topic"))), ["topic"])
    live = values.where("invalid_at is null")
    keyed = live.select("org_id", F.explode(prefixes(F.col("key"))).alias("prefix"), F.col("topic").alias("of_topic"), "claim_key", "value", "valid_at")
    state = keyed.join(topics.select("org_id", "topics", F.concat(F.lit("state:"), "topic").alias("prefix")), ["org_id", "prefix"])
    state = state.select("org_id", "topics", F.col("of_topic").alias("topic"), "claim_key", "value", F.col("valid_at").alias("since")).distinct()

    under = facts.where("topic is not null").select("org_id", "fact_id", F.explode(prefixes(F.col("topic"))).alias("topic")).join(topics, ["org_id", "topic"]).select("org_id", "topics", "fact_id")
    marked = facts.where("phase = 'build'").join(groups, "org_id").select("org_id", "topics", "fact_id")
    return members, state, under.unionByName(marked).distinct().join(facts.select("fact_id", "fact", "tier"), "fact_id")


def builder_briefs(hops: DataFrame, values: DataFrame, facts: DataFrame, episodes: DataFrame, now: Column, window_days: int = 30, grouped: bool = False) -> dict[str, DataFrame]:
    """The sections of every hop's brief, each a table by (org_id, hop).

    ``hops``: org_id, hop, workspace, topics (array of id, phase);
    ``values``: org_id, key, topic, claim_key, value, valid_at, invalid_at;
    ``facts``: fact_id, org_id, scope, workspace, phase, topic, fact, tier, hops;
    ``episodes``: event_id, org_id, occurred_at, action_type, hop, version, score, runs, decision, run_result, kind, value.

    A topic of the build phase takes what begins with it; ``{me}`` and stars at
    its end are left out.  Of the fleet's facts a hop gets those that name it or
    name no hop.  Deviations are the organisation's.  State and learnings are as
    many rows as hops times what is under their topics; ``grouped`` leaves them by
    (org_id, topics), and adds members (org_id, hop, topics).
    """
    own = hops.select("org_id", "hop", "workspace")
    members, state, learnings = by_topics(hops, values, facts)
    if not grouped:
        state = members.join(state, ["org_id", "topics"]).select("org_id", "hop", "topic", "claim_key", "value", "since")
        learnings = members.join(learnings, ["org_id", "topics"]).select("fact_id", "org_id", "hop", "fact", "tier")
    recent = episodes.where(F.col("occurred_at") >= now - F.make_dt_interval(days=F.lit(window_days)))
    scored = recent.where("action_type = 'hop.eval_scored'").join(own.select("org_id", "hop"), ["org_id", "hop"])
    scores = ranked(scored, ["org_id", "hop"], [F.desc("occurred_at"), "event_id"], 1 << 30).select("org_id", "hop", "n", "version", "score", "runs", "decision")
    kin = own.select("org_id", "hop", hop_base(F.col("hop")).alias("base"))
    runs = recent.where("action_type = 'run.completed'").withColumn("base", hop_base(F.col("hop"))).groupBy("org_id", "base", "run_result").agg(F.count("*").alias("n")).join(kin, ["org_id", "base"]).drop("base")
    told = recent.where((F.col("action_type") == "deviation") | ((F.col("action_type") == "memory.claim") & (F.col("kind") == "deviation")))
    first = F.get(F.split(F.trim(F.coalesce("value", F.lit(""))), "\n"), F.lit(0))
    deviation = F.when(first.startswith("kind:"), F.trim(F.replace(first, F.lit("kind:"), F.lit("")))).otherwise("unknown")
    deviations = told.groupBy("org_id", deviation.alias("deviation")).agg(F.count("*").alias("n")).join(own.select("org_id", "hop"), "org_id")

    shared = facts.where((F.col("scope") == "org") & F.coalesce(F.col("phase") != "build", F.lit(True))).select("fact_id", "org_id", F.col("workspace").alias("_ws"), "fact")
    # a workspace has few of its facts told: the first of each are enough to choose from
    few = ranked(shared, ["org_id", "_ws"], ["fact_id"], COMPANY).drop("n")
    met = few.join(own, "org_id").where(F.col("workspace").isNull() | F.col("_ws").isNull() | (F.col("_ws") == F.col("workspace")))
    company = ranked(met.select("org_id", "hop", "fact_id", "fact"), ["org_id", "hop"], ["fact_id"], COMPANY)

    fleet = facts.where("scope = 'global'").select("fact_id", "fact", F.col("hops").alias("_hops"))
    open_ = fleet.where(F.coalesce(F.size("_hops"), F.lit(0)) <= 0).select("fact_id", "fact").orderBy("fact_id").limit(FLEET)
    named = ranked(fleet.select("fact_id", "fact", F.explode("_hops").alias("hop")).distinct(), ["hop"], ["fact_id"], FLEET).drop("n")
    for_all = own.select("org_id", "hop", F.explode(open_.agg(F.collect_list(F.struct("fact_id", "fact"))).scalar()).alias("f")).select("org_id", "hop", "f.*")
    fleet = ranked(for_all.unionByName(own.select("org_id", "hop").join(named, "hop").select("org_id", "hop", "fact_id", "fact")), ["org_id", "hop"], ["fact_id"], FLEET)
    return {"state": state, "learnings": learnings, "scores": scores, "runs": runs, "deviations": deviations, "company": company, "fleet": fleet} | ({"members": members} if grouped else {})
