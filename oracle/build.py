"""Assemble a query from the CTEs it mentions, in dependency order."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _mentions(text: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", text))
    return [n for n in names if n in words]


def query(final: str) -> str:
    """``final`` preceded by every CTE it needs (CTEs are registered in dependency order)."""
    names = list(CTES)
    needed: set[str] = set()
    stack = _mentions(final, names)
    while stack:
        name = stack.pop()
        if name in needed:
            continue
        needed.add(name)
        stack += [n for n in _mentions(CTES[name], names) if names.index(n) < names.index(name)]
    if not needed:
        return final
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in names if n in needed)
    return f"WITH {parts}\n{final}"
