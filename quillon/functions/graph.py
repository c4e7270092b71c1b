"""Temporal predicates, causal vocabulary and chain arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MECHANISTIC = ("CAUSES", "ENABLES", "PREVENTS", "INHIBITS")
DEPENDENCY = ("TRIGGERS", "REQUIRES")
REGULATORY = ("SUPERSEDES", "AMENDS", "QUALIFIES", "CONTRADICTS", "REPEALS", "EXEMPTS")
CAUSAL_TYPES = (*MECHANISTIC, *DEPENDENCY, *REGULATORY, "CORRELATED_WITH")
INFRASTRUCTURE_TYPES = ("__version_supersedes__",)
DECAY = 0.9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def state(c: Column | str = "assertion_state") -> Column:
    """Unknown and missing states count as active."""
    return F.when(F.lower(_col(c)).isin("retracted", "superseded"), F.lower(_col(c))).otherwise("active")


def active_at(t: Column, mode: str = "reference", prefix: str = "") -> Column:
    """Valid at t (from the start on, before the end). reference: and in state active; bitemporal: in any state, by the intervals alone."""
    valid_from, valid_to = F.col(f"{prefix}valid_from"), F.col(f"{prefix}valid_to")
    valid = (valid_from.isNull() | (t >= valid_from)) & (valid_to.isNull() | (t < valid_to))
    return valid if mode == "bitemporal" else valid & (state(f"{prefix}assertion_state") == "active")


def is_active(mode: str = "reference", prefix: str = "") -> Column:
    return active_at(F.current_timestamp(), mode, prefix)


def is_causal(c: Column | str = "relation_type") -> Column:
    return _col(c).isin(*CAUSAL_TYPES)


def is_infrastructure(c: Column | str = "relation_type") -> Column:
    return _col(c).isin(*INFRASTRUCTURE_TYPES)


def causal_family(c: Column | str = "relation_type") -> Column:
    return F.when(_col(c).isin(*MECHANISTIC), "mechanistic").when(_col(c).isin(*DEPENDENCY), "dependency").when(_col(c).isin(*REGULATORY), "regulatory").when(is_causal(c), "correlation")


def strength_passes(least: float | None, c: Column | str = "causal_strength") -> Column:
    """A missing strength counts as 1."""
    return F.lit(True) if least is None else F.coalesce(_col(c), F.lit(1.0)) >= least


def confidence_passes(least: float | None, c: Column | str = "conf_overall") -> Column:
    """A missing confidence passes."""
    return F.lit(True) if least is None else _col(c).isNull() | (_col(c) >= least)


def chain_strength(strengths: Column | str) -> Column:
    """Geometric mean, each factor at least 1e-9; 1 for no factor."""
    s = _col(strengths)
    logs = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.ln(F.greatest(x.cast("double"), F.lit(1e-9))))
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.exp(logs / F.size(s)))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def chain_confidence(hops: Column | str, entities: Column | str, decay: float = DECAY) -> Column:
    """Product of hop confidences, the i-th times decay ** i, capped by the least hop and the least entity; 0 for no hop, null if there are neither as many entities as hops nor one more."""
    h, e = _col(hops), _col(entities)
    product = F.aggregate(F.transform(h, lambda c, i: _unit(c) * F.pow(F.lit(decay), i.cast("double"))), F.lit(1.0), lambda a, x: a * x)
    capped = F.least(product, _unit(F.array_min(h)), _unit(F.array_min(e)))
    return F.when(F.size(h) == 0, F.lit(0.0)).when((F.size(e) == F.size(h)) | (F.size(e) == F.size(h) + 1), capped)


def approximate_chain_confidence(mean: Column | str, hops: Column | str, decay: float = DECAY) -> Column:
    n = _col(hops).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(_unit(F.pow(_unit(_col(mean)), n) * F.pow(F.lit(decay), n * (n - 1) / 2)))


def confidence_ceiling_hop(hops: Column | str) -> Column:
    """Place of the first least hop, from 0; null for no hop."""
    h = _col(hops)
    return F.when(F.size(h) > 0, F.array_position(h, F.array_min(h)) - 1)


def citation_string(locator: Column, page: Column, segment: Column, start: Column, end: Column) -> Column:
    """The trimmed locator, else page and segment, else segment, else the range of characters, else null."""
    trimmed = F.nullif(F.trim(locator), F.lit(""))
    return F.coalesce(trimmed, F.concat(F.lit("p."), page.cast("string"), F.lit(" segment "), segment.cast("string")), F.concat(F.lit("segment "), segment.cast("string")), F.concat(F.lit("chars "), start.cast("string"), F.lit("-"), end.cast("string")))
