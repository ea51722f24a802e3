"""Table operators: filters, collapse, retrieval, top-k."""
