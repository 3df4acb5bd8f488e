"""Operators of a training-data pipeline: deduplication, archives, chat, scans, filters and mixing."""
