"""Registry of cross-check queries: a Spark callable and, where SQL can say it, an oracle."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosscheck.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def oracle(sql: str) -> str:
    """Prefix a statement with the derived views it (transitively) reads."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = oracle(sql)
        return fn
    return register
