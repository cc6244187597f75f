"""Name -> query and name -> DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from tessera.plans import acceptance, answers, articles, base, bundles, concepts, conversation, deletion, documents, knowledge, layout, lint, profiles, review, routed, search, stages, verification, workflow  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
