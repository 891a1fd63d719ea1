"""Sources: feeds, article pages, remote page listings, lookup tables and the ledger."""
