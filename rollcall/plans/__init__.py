"""Registered queries over the driver's tables, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    from rollcall.plans import flows, inventory, recognition, relational

    return [relational, recognition, inventory, flows]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in vars(m).items() if k[:1] == "q" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """A query named q12_name has its SQL in Q12 of its module."""
    out = {}
    for m in _modules():
        for k in vars(m):
            if k[:1] == "q" and k[1:2].isdigit() and hasattr(m, sql := k.split("_")[0].upper()):
                out[k] = getattr(m, sql)
    return out
