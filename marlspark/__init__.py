"""Document retrieval, catalog reconciliation and file intake as Spark jobs."""
