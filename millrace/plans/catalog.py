"""Registry of every query outside the optional subpackage."""

from __future__ import annotations

from millrace.plans import corpus, events, problems, relational, search, sources, streams

MODULES = (problems, search, corpus, events, relational, streams, sources)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

flagship = search.context_budget
