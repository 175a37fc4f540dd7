"""Named queries over the driver's tables, each with SQL text that another engine can run where SQL can say it."""

from . import backgrounds, caches, evidence, grids, motions, series, streams, tables  # noqa: F401  they register their queries
from .register import ORACLE_SQL, QUERIES

FLAGSHIP = "alarm_scores"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
