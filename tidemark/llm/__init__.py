"""Operators of a training-data pipeline: deduplication, filtering, packing, extraction, scoring. Nothing else imports this package."""
