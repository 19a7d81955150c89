"""The fold of episodes into memory: gate, edges, identity, ontology, values and topic states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import pii_kinds, redact, slug
from annalist.operators.governance import daily_budget, drop_reason, resolve_consent
from annalist.operators.retrieve import small
from annalist.sources.shared import keep


def fold_gate(episodes: DataFrame, consent: DataFrame, deny: Column, allow: Column, floor: float, cap: int) -> DataFrame:
    """``dropped_reason`` of each episode, null if it is folded: consent, then policy, then (documents) budget and
    salience, then personal data in claims above a person.  The budget counts what the rules before it let through."""
    judged = resolve_consent(episodes, consent).withColumn("_policy", drop_reason(F.col("source"), deny, allow))
    document = F.col("action_type") == "document.ingested"
    open_ = F.col("consent_reason").isNull() & F.col("_policy").isNull()
    counted = daily_budget(judged.where(open_ & document), ["source"], F.lit(cap)).withColumnRenamed("drop_reason", "_budget")
    rest = judged.where(~(open_ & document)).withColumn("_budget", F.lit(None).cast("string"))
    low = F.when(document & (F.col("salience") < floor), F.concat(F.lit("salience:"), F.col("salience").cast("string")))
    claim = (F.col("action_type") == "memory.claim") & (F.col("scope") != "user")
    kinds = pii_kinds(F.coalesce("content", F.lit("")))
    personal = F.when(claim & (F.size(kinds) > 0), F.concat(F.lit("pii:"), F.array_join(kinds, "+")))
    both = counted.unionByName(rest)
    return both.withColumn("dropped_reason", F.coalesce("consent_reason", "_policy", "_budget", low, personal)).drop("consent_reason", "_policy", "_budget")


def redact_map(values: Column) -> Column:
    """The string values of a mapping with their secrets replaced."""
    return F.transform_values(values, lambda _, v: redact(v)[0])


def governs(targets: DataFrame, administered: DataFrame) -> DataFrame:
    """May the caller govern the target scope: their own, a unit they administer, or anything as an admin?"""
    held = administered.select("caller_id", F.col("unit_id").alias("scope_id"), F.lit(True).alias("_held")).distinct()
    met = targets.join(held, ["caller_id", "scope_id"], "left")
    own = (F.col("scope") == "user") & (F.col("scope_id") == F.col("caller_id"))
    return met.withColumn("governs", F.col("is_admin") | own | ((F.col("scope") == "team") & F.col("_held").isNotNull())).drop("_held")


def mentions(episodes: DataFrame, most: int = 10) -> DataFrame:
    """(event_id, type, key, aliases): the first ``most`` entity hints of an episode as MENTIONS edges."""
    return episodes.select("event_id", F.explode(F.slice("hints", 1, most)).alias("h")).select("event_id", F.lit("MENTIONS").alias("type"), slug(F.col("h.name")).alias("key"), F.array_sort(F.col("h.aliases")).alias("aliases")).distinct()


def valid_until(text: Column) -> Column:
    """An ISO-8601 instant, without a zone read as the session's; null for anything else."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def upsert_edges(observed: DataFrame, key: list[str]) -> DataFrame:
    """One open edge for each identity: the first start, the last fact, and how often it was told."""
    order = F.struct("valid_at", "event_id")
    return observed.groupBy(*key).agg(F.min("valid_at").alias("valid_at"), F.max_by("fact", order).alias("fact"), F.count("*").alias("observed_count"))


def resolve_by_key(observed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities with the id of the node of the same type and key, or the one they would get."""
    met = observed.join(nodes.select("type", "key", F.col("node_id").alias("_id")), ["type", "key"], "left")
    return met.withColumn("is_new", F.col("_id").isNull()).withColumn("node_id", F.coalesce("_id", F.concat_ws(":", "type", "key"))).drop("_id")


def effective_ontology(core: DataFrame, extensions: DataFrame) -> DataFrame:
    """Classes of the core, and each tenant's own whose name the core does not have."""
    own = extensions.select("org_id", F.explode("classes").alias("class")).distinct()
    everyone = extensions.select("org_id").distinct()
    classes = core.agg(F.collect_set("class")).scalar()  # the core's are a closed set
    return everyone.select("org_id", F.explode(classes).alias("class")).withColumn("origin", F.lit("core")).unionByName(
        own.join(core.select("class"), "class", "left_anti").select("org_id", "class").withColumn("origin", F.lit("extension"))
    )


def subject_words(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(subject), "[^a-z0-9]+"), lambda w: w != ""))


def known_subjects(states: DataFrame, anchors: DataFrame, least: float = 0.5) -> DataFrame:
    """The known anchor of each subject: one whose words hold the subject's or are held by them, else the best Jaccard
    of ``least`` or more, else the subject's own slug.  Met through shared words, each subject once; ties go to the least anchor."""
    own = states.select("subject").distinct().select("subject", subject_words(F.col("subject")).alias("_own"))
    known = anchors.select("anchor", subject_words(F.col("anchor")).alias("_known"))
    met = own.select("subject", F.size("_own").alias("_n"), F.explode("_own").alias("word")).join(known.select("anchor", F.size("_known").alias("_m"), F.explode("_known").alias("word")), "word")
    both = met.groupBy("subject", "anchor", "_n", "_m").agg(F.count("*").alias("_both"))
    inside = F.col("_both") == F.least("_n", "_m")
    jaccard = F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))
    fit = both.where(inside | (jaccard >= least))
    order = Window.partitionBy("subject").orderBy(F.desc(inside), F.desc(F.when(inside, 1.0).otherwise(jaccard)), "anchor")
    best = fit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("subject", "anchor")
    met = states.join(small(keep(best), ["subject", "anchor"]), "subject", "left")
    return met.select(*states.columns, F.coalesce("anchor", slug(F.col("subject"))).alias("anchor"))


def valid_states(candidates: DataFrame, kinds: tuple[str, ...] = ("state", "preference", "record"), most: int = 60, gate: str = ".") -> DataFrame:
    """Candidates of a known kind, with a key of at most ``most`` signs and no dots or slashes; the first of each key."""
    kept = candidates.where(F.col("kind").isin(*kinds) & ~F.col("key").rlike(r"[./]") & (F.char_length("key") <= most) & F.col("value").rlike(gate))
    order = Window.partitionBy("event_id", "key").orderBy("position")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dated_facts(candidates: DataFrame, sessions: DataFrame) -> DataFrame:
    """Conversation facts named by the date of the event, or else of the session."""
    met = candidates.join(sessions.select("session_id", "session_date"), "session_id", "left")
    day = F.coalesce("event_date", "session_date")
    return met.withColumn("valid_at", day).withColumn("name", F.concat(F.lit("["), F.date_format(day, "yyyy-MM-dd"), F.lit("] "), "fact"))


def topic_lines(tallies: DataFrame, most: int = 400) -> DataFrame:
    """A topic's sums by unit as one line of at most ``most`` signs, cut behind the last whole part."""
    part = F.trim(F.concat_ws(" ", F.format_string("%.1f", "total"), "unit"))
    per = tallies.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", part.alias("p")))), lambda x: x["p"]), "; ").alias("line"))
    head = F.substring("line", 1, most)
    return per.withColumn("line", F.when(F.char_length("line") <= most, F.col("line")).otherwise(F.regexp_replace(head, ";[^;]*$", "")))


def current_topics(edges: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Open values of keyed topics that begin and end so."""
    return edges.where(F.col("invalid_at").isNull() & F.col("anchor_key").startswith(prefix) & F.col("anchor_key").endswith(suffix))


def anchor_text(topic: Column, generic: tuple[str, ...] = ("state", "watch", "status", "config")) -> Column:
    """A topic's path words as a subject to be read, the generic ones behind it in parentheses."""
    words = F.filter(F.split(F.lower(topic), "[/:_-]+"), lambda w: w != "")
    own, common = F.filter(words, lambda w: ~w.isin(*generic)), F.filter(words, lambda w: w.isin(*generic))
    return F.trim(F.concat(F.array_join(own, " "), F.when(F.size(common) > 0, F.concat(F.lit(" ("), F.array_join(common, " "), F.lit(")"))).otherwise(F.lit(""))))


def topic_states(facts: DataFrame) -> DataFrame:
    """(topic, line): candidate facts folded to tallies; topics whose tally is empty are left out."""
    from annalist.operators.extract import fold_topics

    tallies = fold_topics(facts).where("n > 0 and total > 0")
    return topic_lines(tallies).withColumn("anchor", F.concat(F.lit("state:"), F.col("topic").cast("string")))


def re_embed(rows: DataFrame, model: str, embed) -> DataFrame:
    """Rows that carry a vector of another model, or none, embedded anew; others as they are.

    ``embed`` maps (row_id, text) to (row_id, embedding).
    """
    stale = F.col("model").isNull() | (F.col("model") != model)
    fresh = rows.where(stale).drop("embedding").join(embed(rows.where(stale).select("row_id", "text")), "row_id").withColumn("model", F.lit(model))
    return rows.where(~stale).unionByName(fresh.select(rows.columns))


def admit_items(items: DataFrame, least: int = 50) -> DataFrame:
    """Items as document episodes; those with hardly any text are declined as empty."""
    reason = F.when(F.char_length(F.trim(F.coalesce("text", F.lit("")))) < least, "empty")
    return items.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "admitted").otherwise("declined"))
