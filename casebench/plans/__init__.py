"""The queries of the library's own operators."""

from casebench.plans import cases, logs, rules, search, state  # noqa: F401
from casebench.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
