"""Column functions: identifiers and scores."""
