"""All queries: importing a module of plans registers its queries in the catalog."""

from __future__ import annotations

from codeloom.plans import code_plans, flow_plans, knowledge_plans, lookup_plans, maintenance_plans, retrieval_plans, source_plans, text_plans  # noqa: F401
from codeloom.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401
