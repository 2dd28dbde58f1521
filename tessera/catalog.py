"""The queries of the evidence operators, and the SQL that each is compared with."""

from __future__ import annotations

from tessera.plans import addresses, answers, bundles, defaults, digests, evaluation, evidence, ingest, loop, policy, profiles, records, support, texts  # noqa: F401  (they register their queries)
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "prompt_slate"
