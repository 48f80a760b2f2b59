"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import catalogues, changes, documents, indexing, records, reports, retrieval

QUERIES = retrieval.QUERIES | catalogues.QUERIES | documents.QUERIES | indexing.QUERIES | changes.QUERIES | reports.QUERIES | records.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | catalogues.ORACLE_SQL | documents.ORACLE_SQL | indexing.ORACLE_SQL | changes.ORACLE_SQL | reports.ORACLE_SQL | records.ORACLE_SQL
FLAGSHIP = "hybrid_search"
