"""Registered queries over the operators, each with the SQL that says the same."""

from __future__ import annotations

from quern.plans import derived, groups, lookups, more, network, roles, texts
from quern.plans.registry import Query

FLAGSHIP = "q10_customer_regions"
_ALL = [derived.r, derived.g, groups.v, more.r, more.g, groups.t, roles.r, lookups.r, texts.r, texts.g, network.r, network.v, network.w]


def queries() -> dict[str, Query]:
    return {name: f for r in _ALL for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _ALL for name, sql in r.sql.items()}
