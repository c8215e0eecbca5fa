"""All registered queries."""

import importlib

from chainsieve.plans.registry import CHECKS, QUERIES

for _part in ("wallet", "timing", "related", "sources", "features", "labels", "evaluation", "reports", "streaming", "ml"):
    importlib.import_module(f"chainsieve.plans.catalog_{_part}")

__all__ = ["CHECKS", "QUERIES"]
