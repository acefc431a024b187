"""Operators for training-data pipelines: filters, near-duplicates, decontamination, mixing, scoring, chat formatting."""
