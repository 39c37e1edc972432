"""Load scopes: which events to read at all, applied right behind the reader.

A scope never drops a row for something it does not know: a row without a
provider, time or level passes that part.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import driver_time, time_literal
from logloom.functions.text import isin_ci
from logloom.model import LEVELS, UNKNOWN, level_to_int


@dataclass(frozen=True)
class Scope:
    """include None lets all providers in; an empty set none that is known."""

    include: frozenset[str] | None = None
    exclude: frozenset[str] = frozenset()
    time_from: dt.datetime | None = None
    time_to: dt.datetime | None = None
    levels: frozenset[int] | None = None

    def condition(self) -> Column | None:
        parts = []
        no_provider = F.coalesce("provider", F.lit("")) == ""
        if self.include is not None:
            parts.append(no_provider | isin_ci(F.col("provider"), sorted(self.include)) if self.include else no_provider)
        if self.exclude:
            parts.append(no_provider | ~isin_ci(F.col("provider"), sorted(self.exclude)))
        if self.time_from:
            parts.append(F.col("log_time").isNull() | (F.col("log_time") >= time_literal(self.time_from)))
        if self.time_to:
            parts.append(F.col("log_time").isNull() | (F.col("log_time") <= time_literal(self.time_to)))
        if self.levels is not None:
            parts.append(F.col("level").isNull() | (F.col("level") == UNKNOWN) | F.col("level").isin(sorted(self.levels)))
        return reduce(lambda a, b: a & b, parts) if parts else None


def apply_scope(df: DataFrame, scope: Scope | None) -> DataFrame:
    condition = scope.condition() if scope else None
    return df if condition is None else df.where(condition)


def _actions(section: dict):
    for rule in section.get("rules", []):
        if rule.get("enabled", True):
            for action in rule.get("actions") or ([rule["action"]] if rule.get("action") else []):
                if str(action.get("type", "")).lower() == "scope":
                    yield rule, action


def validate_scope(sections: list[dict]) -> list[str]:
    """What is wrong with scope sections; empty if nothing is."""
    problems = []
    for s in sections:
        for rule, a in _actions(s):
            name = rule.get("name", "?")
            if rule.get("match") or rule.get("unmatch"):
                problems.append(f"{name}: a scope rule has no match or unmatch")
            for key in ("timeFrom", "timeTo"):
                if a.get(key) and driver_time(a[key]) is None:
                    problems.append(f"{name}: {key} is not a time: {a[key]}")
            problems += [f"{name}: unknown level: {x}" for x in a.get("levels", []) if level_to_int(x) < 0 and str(x).lower() != "unknown"]
            if a.get("providerMode") and str(a["providerMode"]).lower() not in ("include", "exclude"):
                problems.append(f"{name}: providerMode is include or exclude, not {a['providerMode']}")
    return problems


def build_scope(sections: list[dict]) -> Scope | None:
    """One scope of all scope sections: inclusions and levels intersect, exclusions unite, windows tighten; None without any."""
    scope = None
    for s in sections:
        providers = frozenset(p for p in s.get("providers", []) if p and p != "*")
        for _, a in _actions(s):
            names = frozenset(p.lower() for p in providers | frozenset(a.get("providers", [])))
            now = scope or Scope()
            include, exclude = now.include, now.exclude
            if names and str(a.get("providerMode") or "include").lower() == "exclude":
                exclude = exclude | names
            elif names:
                include = names if include is None else include & names
            start, end = driver_time(a.get("timeFrom")), driver_time(a.get("timeTo"))
            levels = frozenset(level_to_int(x) for x in a.get("levels", [])) or None
            scope = Scope(
                include, exclude,
                max(filter(None, (now.time_from, start)), default=None), min(filter(None, (now.time_to, end)), default=None),
                now.levels if levels is None else levels if now.levels is None else now.levels & levels,
            )
    return scope


def scope_from_selection(providers: list[str] = (), mode: str = "include", time_from: str = "", time_to: str = "", levels: list[str] = ()) -> dict:
    """A rule file with one scope section of a selection."""
    action = {"type": "scope", "providerMode": mode}
    action |= {k: v for k, v in (("timeFrom", time_from), ("timeTo", time_to), ("levels", [x for x in levels if x in LEVELS])) if v}
    return {"schemaVersion": "2.0", "title": "Scope", "sections": [{"name": "Scope", "purpose": "scope", "providers": list(providers) or ["*"], "rules": [{"name": "scope", "match": "", "enabled": True, "action": action}]}]}
