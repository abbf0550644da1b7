"""Operators of a training-data pipeline: filtering, deduplication, redaction, sharding and packing of documents."""
