"""All queries and their SQL."""

from . import catalog, oracle, stored

QUERIES = catalog.QUERIES | stored.QUERIES
ORACLE = oracle.ORACLE | stored.ORACLE
