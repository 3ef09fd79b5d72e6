"""Score, tier and label expressions over judged items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayread.constants import (
    CATCH_LABEL,
    CATCH_ROLES,
    FALLBACK_LABEL,
    HIGH_TIER,
    IRRELEVANT,
    OTHER_WEIGHT,
    ROLE_NAMES,
    ROLES,
)


def role_weight(role: Column) -> Column:
    weight = F
    for name, _, value in ROLES:
        if value != OTHER_WEIGHT:
            weight = weight.when(role == name, F.lit(value))
    return weight.otherwise(F.lit(OTHER_WEIGHT))


def digest_score(p: Column, role: Column, role_p: Column) -> Column:
    """Relevance times role weight, discounted by up to a fifth when the role is uncertain."""
    return F.coalesce(p, F.lit(0.0)) * role_weight(role) * (
        F.lit(0.8) + F.lit(0.2) * F.coalesce(role_p, F.lit(0.0))
    )


def tier(p: Column, high: float = HIGH_TIER) -> Column:
    return F.when(p >= high, F.lit("hi")).otherwise(F.lit("mid"))


def label(role: Column, is_catch: Column) -> Column:
    text = F.when(is_catch, F.lit(CATCH_LABEL))
    for name, name_label, _ in ROLES:
        text = text.when(role == name, F.lit(name_label))
    return text.otherwise(F.lit(FALLBACK_LABEL))


def needed(role: Column) -> Column:
    """True when the role is set and is not the irrelevant one."""
    return F.coalesce(role, F.lit(IRRELEVANT)) != IRRELEVANT


def is_catch_role(role: Column) -> Column:
    return F.coalesce(role.isin(CATCH_ROLES), F.lit(False))


def known_role(role: Column) -> Column:
    return F.when(role.isin(ROLE_NAMES), role).otherwise(F.lit(IRRELEVANT))


def as_float(c: Column, default: float = 0.0) -> Column:
    """Number or numeric string as a double; anything else, and NaN, gives the default."""
    return F.nanvl(F.coalesce(c.try_cast("double"), F.lit(default)), F.lit(default))
