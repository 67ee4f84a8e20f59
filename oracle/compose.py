"""Put a query together from named parts: each part becomes a CTE if the query needs it."""

from __future__ import annotations

import re

WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def needed(sql: str, parts: dict[str, str], seen: dict[str, None] | None = None) -> dict[str, None]:
    seen = {} if seen is None else seen
    for word in dict.fromkeys(WORD.findall(sql)):
        if word in parts and word not in seen:
            below = {k: v for k, v in parts.items() if k != word}
            needed(parts[word], below, seen)
            seen[word] = None
    return seen


def compose(sql: str, parts: dict[str, str]) -> str:
    names = needed(sql, parts)
    ctes = ",\n".join(f"{name} AS (\n{parts[name].strip()}\n)" for name in names)
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()


def settled(expr: str) -> str:
    """Four decimals, as `cellarbook.plans.catalog.settle` rounds them; adding zero makes -0.0 a plain 0.0."""
    return f"round(round(CAST({expr} AS DOUBLE), 9), 4) + 0.0"


def rounded(table: str, doubles: str = "") -> str:
    """`SELECT *` with the named double columns rounded."""
    swaps = [f"{settled(c)} AS {c}" for c in doubles.split()]
    return f"SELECT * REPLACE ({', '.join(swaps)}) FROM {table}" if swaps else f"SELECT * FROM {table}"
