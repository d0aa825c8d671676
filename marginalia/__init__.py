"""Content analytics on Spark: typed relations over published HTML content, detectors, ledger, reports."""
