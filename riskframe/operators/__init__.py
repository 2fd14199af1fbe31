"""Distributed operators: history aggregates, positions, binning, selection, metrics."""
