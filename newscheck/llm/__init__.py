"""Operators of a training-data pipeline: language, privacy, licences, duplicates, search, packing."""
