"""Scores and times as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    """Microseconds of an instant, with or without a zone (read as the session's)."""
    return F.unix_micros(at.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def recency(valid_at: Column, now: Column) -> Column:
    """exp(-age in days / 365); an unknown date counts one half."""
    return F.when(valid_at.isNull(), 0.5).otherwise(F.exp(-F.greatest(days_between(now, valid_at), F.lit(0.0)) / 365))


# Fixed values of the functions below: half-lives in days and their floor, places and weights of fusion, tiers of trust.
def recency_factor(valid_at: Column, now: Column, half_life: float = 180, floor: float = 0.35) -> Column:
    """Halved every ``half_life`` days, never below ``floor``; 1 without a date."""
    return F.coalesce(F.greatest(F.lit(floor), F.pow(F.lit(2.0), -F.greatest(days_between(now, valid_at), F.lit(0.0)) / half_life)), F.lit(1.0))


def half_life_days(text: Column) -> Column:
    """'90d', '12h', '2w', '3m', '1y' as days; null for '2x' and what cannot be read."""
    number = F.nullif(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([hdwmy])$", 1), F.lit("")).cast("double")
    unit = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([hdwmy])$", 2)
    days = F.when(unit == "h", 1 / 24).when(unit == "d", 1.0).when(unit == "w", 7.0).when(unit == "m", 30.0).when(unit == "y", 365.0)
    return number * days


def kind_half_life(kind: Column) -> Column:
    """Days by kind of fact; null: no decay."""
    return F.when(kind.isin("learning", "record"), 365.0).when(kind == "deviation", 90.0).when(kind.isin("state", "preference"), None).otherwise(180.0)


def decay(kind: Column, override: Column, stamp: Column, now: Column, floor: float = 0.35) -> Column:
    """Decay of a fact by the half-life of its kind, or its own; '2x' has no clock decay."""
    days = F.coalesce(half_life_days(override), F.when(override.rlike("^[0-9.]+x$"), None).otherwise(kind_half_life(kind)))
    return F.when(override.rlike("^[0-9.]+x$") | days.isNull() | stamp.isNull(), 1.0).otherwise(
        F.greatest(F.lit(floor), F.pow(F.lit(2.0), -F.greatest(days_between(now, stamp), F.lit(0.0)) / days))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def rrf_weight(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    """One leg's part of reciprocal rank fusion."""
    return (F.lit(weight) if isinstance(weight, (int, float)) else weight) / (k + rank)


def as_of(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end, a null end being open."""
    return (start <= at) & (end.isNull() | (end > at))


def windows_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Do two half-open intervals meet? Touching ends do not."""
    return (a_end.isNull() | (a_end > b_start)) & (b_end.isNull() | (b_end > a_start))


def trust_tier(endorsed: Column, grounded: Column, observed: Column, passes: Column, fails: Column) -> Column:
    return (
        F.when(endorsed, "endorsed")
        .when(~grounded, "probation")
        .when(((observed >= 2) | (passes >= 3)) & (fails == 0), "corroborated")
        .otherwise("probation")
    )


# Importance by action.
IMPORTANCE = {
    "org.member_added": 0.8, "org.role_changed": 0.8, "agent.created": 0.8, "agent.deployed": 0.8, "mcp.deployed": 0.8, "skill.published": 0.8, "build.session.completed": 0.9,
    "agent.decided": 0.9, "fact.observed": 0.9, "chat.message": 0.6, "skill.used": 0.4, "mcp.tool.invoked": 0.2, "tool.invoked": 0.2, "usage.recorded": 0.1,
}


def importance(action: Column) -> Column:
    """Importance by action; 0.5 if not listed."""
    return F.coalesce(*[F.when(action == k, v) for k, v in IMPORTANCE.items()], F.lit(0.5))
