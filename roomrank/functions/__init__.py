"""Column -> Column helpers; all native Spark expressions (no Python UDFs)."""
