"""DataFrame operators: selection, content, similarity, enrichment, records, retention."""
