"""DataFrame -> DataFrame operators of the ledger, one module per join group."""
