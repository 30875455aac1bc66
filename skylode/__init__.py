"""Skylode: a PySpark engine that turns tables of windowed measurements into short, ordered lists of anomalies."""
