"""Query catalogue of the protocol engine: Spark query and oracle SQL by name."""

from __future__ import annotations

from . import asked, builds, search, store, stored, texts

QUERIES = search.QUERIES | texts.QUERIES | store.QUERIES | builds.QUERIES | asked.QUERIES | stored.QUERIES
ORACLE = search.ORACLE | texts.ORACLE | store.ORACLE | builds.ORACLE | asked.ORACLE | stored.ORACLE
