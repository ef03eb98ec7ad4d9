"""All registered queries and their SQL."""

from __future__ import annotations

from stratum.plans import files, forward, places, posterior, prepare, solve  # noqa: F401
from stratum.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
