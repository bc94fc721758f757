"""Named queries: a Spark function of (spark, sf_dir), and where SQL can say it, the same query as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def sql(body: str, *views: str) -> str:
    """``body`` after the common table expressions ``views``; a body may begin with ``,`` and further expressions.

    A view begins a line of its own and is materialised, so that one used several times is computed once.
    """
    kept = [re.sub(r"(?m)^(\w+(?:\([^)]*\))?) AS \(", r"\1 AS MATERIALIZED (", view) for view in views]
    return ("WITH " + ",".join(kept) if kept else "") + "\n" + body
