"""Jobs composed of operators: search, term mining, quality checks, contexts, reports."""
