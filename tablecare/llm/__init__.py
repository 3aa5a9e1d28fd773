"""Operators of a training-data pipeline: extraction, filtering, deduplication,
mixing and packing. Nothing else in the library imports this subpackage."""
