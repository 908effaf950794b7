"""Status words and the healthy predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four status words, and the legacy words some sources report.
OK = "ok"
WARNING = "warning"
CRITICAL = "critical"
UNKNOWN = "unknown"
STATUSES = (OK, WARNING, CRITICAL, UNKNOWN)
STATUS_ALIASES = {"healthy": OK, "failed": CRITICAL, "unhealthy": CRITICAL}


def normalize_status(word: Column) -> Column:
    """Lower-cased status word; legacy aliases mapped; anything else is ``unknown``."""
    w = F.lower(F.trim(word))
    aliased = w
    for alias, status in STATUS_ALIASES.items():
        aliased = F.when(w == alias, F.lit(status)).otherwise(aliased)
    return F.when(aliased.isin(*STATUSES), aliased).otherwise(F.lit(UNKNOWN))


def is_healthy(status: Column) -> Column:
    """Healthy means ``ok``; ``warning`` counts as unhealthy. Never NULL."""
    return F.coalesce(status == F.lit(OK), F.lit(False))
