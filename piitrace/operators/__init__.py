"""Set-at-a-time operators: extraction, entity graph, redaction, scoring, summaries."""
