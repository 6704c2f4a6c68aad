"""Column expressions: score arithmetic, entity classifiers, text patterns."""
