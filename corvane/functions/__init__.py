"""Column expressions: text, numbers, entailment scores and statistics."""
