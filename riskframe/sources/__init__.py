"""Loan-table scans, integrity guards and sinks."""
