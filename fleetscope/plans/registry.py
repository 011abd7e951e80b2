"""Collects the registered queries and oracle SQL of every plan module."""

from __future__ import annotations

import importlib

PLAN_MODULES = [
    "q_snapshots",
    "q_snapshots2",
    "q_querystats",
    "q_blocking",
    "q_backups",
    "q_catalog",
    "q_capacity",
    "q_deadlocks",
    "q_plandocs",
    "q_governance",
    "q_documents",
    "q_streaming",
    "q_relational",
    "q_rules_extra",
    "q_functions",
    "q_health",
]


def _modules():
    return [importlib.import_module(f"fleetscope.plans.{m}") for m in PLAN_MODULES]


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        for k, v in m.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out


def all_oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
