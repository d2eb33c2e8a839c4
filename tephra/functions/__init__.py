"""Column expressions: calendar keys, distances, cleaning and small statistics."""
