"""Equivalent SQL for the registered queries, one module per query group."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import corpus, evaluation, models, stores, tables, text

    found = {}
    for module in (tables, text, corpus, models, evaluation, stores):
        found.update(module.SQL)
    return found
