"""All registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from veldra.plans import chunks, dealt, feeds, vectors

QUERIES: dict[str, Callable] = {**dealt.QUERIES, **vectors.QUERIES, **chunks.QUERIES, **feeds.QUERIES}
ORACLES: dict[str, str] = {**vectors.ORACLES, **chunks.ORACLES, **feeds.ORACLES}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
