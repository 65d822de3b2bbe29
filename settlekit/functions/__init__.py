"""Column-level business rules, one module per level of the ledger."""
