"""lectern: document indexing, retrieval, catalogue queries, curation and audits on Spark."""
