"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from cloakwork.plans import acting, agent, attributes, boxes, detection, forms, goals, pages, places, streams

PARTS = (detection, goals, pages, forms, places, attributes, agent, acting, boxes, streams)
QUERIES: dict = {k: f for part in PARTS for k, f in part.QUERIES.items()}
SQL: dict[str, str] = {k: s for part in PARTS for k, s in part.SQL.items()}
