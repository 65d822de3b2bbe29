"""Whole jobs: the ledger, its reports and data-quality checks."""
