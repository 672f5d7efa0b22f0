"""Drift-adaptive anomaly analytics and corpus preparation on Spark."""
