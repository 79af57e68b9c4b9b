"""Demand-driven JSON analytics on Spark."""
