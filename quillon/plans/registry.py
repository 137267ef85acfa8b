"""All queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from quillon.operators import blocks, books, caching, context, evidence, identity, images, layout, ledger, manifests, markup, panels, prompts, records, rules, scheduling, state
from quillon.streaming import fencing

_MODULES = [identity, books, ledger, images, manifests, layout, panels, blocks, rules, caching, scheduling, evidence, state, records, markup, prompts, context, fencing]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
