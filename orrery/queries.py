"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "volume_minimum_slice"

for _name in ("volume", "filters", "state", "runs", "geometry", "surfaces", "lang", "sources"):
    _plan = importlib.import_module(f"{__package__}.plans.{_name}")
    QUERIES |= _plan.Q
    ORACLES |= _plan.S
