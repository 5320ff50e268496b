"""Step-style ETL, reconciliation, lineage and job analytics on Spark."""
