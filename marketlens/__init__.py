"""Marketplace price analytics on Spark: ingest, change logs, classification, valuation."""
