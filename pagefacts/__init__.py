"""Web-page facts on Spark: statements, reconciliation, review and publishing as DataFrame jobs."""
