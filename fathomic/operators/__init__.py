"""Estimators, metrics and splitters."""
