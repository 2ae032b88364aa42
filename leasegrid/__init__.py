"""Lease-obligation analytics on Spark: DataFrame operators keyed by lease."""
