"""Column expressions: times, names, routing, sample arrays."""
