"""Column expressions: text, calendar, labels, lookups."""
