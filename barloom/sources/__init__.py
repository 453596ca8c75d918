"""Scans of landed pages, raw partitions and price datasets."""
