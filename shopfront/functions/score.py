"""The lead score as column expressions over a denormalised lead table.

All arithmetic is in whole numbers: confidence is a percentage, and the score is
(total * percentage + 50) div 100, which is round-half-up without binary fractions.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def lookup(key: Column, mapping: dict, default) -> Column:
    """Value of a key in a small constant mapping.

    A few entries become a CASE; more become one map literal, which keeps generated code small.
    """
    if len(mapping) > 8:
        entries = [F.lit(x) for pair in mapping.items() for x in pair]
        found = F.try_element_at(F.create_map(*entries), key)
        return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))
    out = None
    for name, value in mapping.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def flag_points(flag: str, points: int) -> Column:
    return F.when(F.col(flag), points).otherwise(0)


def known_followers() -> Column:
    """A typed-in number wins; a scraped one counts only when its state is known."""
    return F.coalesce(F.col("manual_override"), F.when(F.col("followers_state") == "known", F.col("followers")))


def magnitude_tier(followers: Column) -> Column:
    out = F.when(followers.isNull(), "unknown")
    for bound, tier in dims.TIER_BOUNDS:
        out = out.when(followers < bound, tier)
    return out.otherwise("atLeast10k")


def web_gap(preset: str = "websites") -> Column:
    points = {**dims.SITE_POINTS, **dims.PRESET_POINTS[preset]}
    return lookup(F.col("site_state"), points, dims.SITE_POINTS["unknown"])


def contactability() -> Column:
    p = dims.CONTACT_POINTS
    total = flag_points("has_phone", p["phone"]) + flag_points("has_email", p["email"]) + flag_points("has_social", p["social"])
    return F.least(F.lit(dims.CONTACT_CAP), total)


def presence() -> Column:
    tier = lookup(F.col("tier"), dims.TIER_POINTS, 0)
    return F.least(F.lit(dims.PRESENCE_CAP), flag_points("has_social", dims.SOCIAL_PRESENCE_POINTS) + tier)


def coverage() -> dict[str, Column]:
    stage = F.col("enrichment_stage")
    return {
        "website_probed": ~F.col("site_state").isin("unknown", "has_tag_unprobed"),
        "contacts_extracted": stage.isin("contacts", "socials", "done"),
        "socials_checked": stage.isin("socials", "done"),
    }


def confidence_pct() -> Column:
    c, pct = coverage(), dims.CONFIDENCE_PCT
    return (
        F.lit(pct["base"])
        + F.when(c["website_probed"], pct["probed"]).otherwise(0)
        + F.when(c["contacts_extracted"], pct["contacts"]).otherwise(0)
        + F.when(c["socials_checked"], pct["socials"]).otherwise(0)
    )


def score(preset: str = "websites") -> Column:
    total = web_gap(preset) + contactability() + presence()
    points = F.floor((total * confidence_pct() + 50) / 100).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("bigint")


def score_reasons() -> Column:
    return F.array_compact(F.array(
        lookup(F.col("site_state"), dims.STATE_REASONS, "website state unknown"),
        F.when(F.col("has_phone"), "phone found"),
        F.when(F.col("has_email"), "email found"),
        F.when(F.col("has_social"), "social presence found"),
        F.when(F.col("tier") == "unknown", "follower count not available"),
        F.when(confidence_pct() < 100, "partially checked"),
    ))
