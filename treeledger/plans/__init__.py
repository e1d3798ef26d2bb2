"""Relations derived from the test tables, and the registered queries beside their SQL."""

from treeledger.plans import more, queries  # noqa: F401  they register what they define
from treeledger.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
