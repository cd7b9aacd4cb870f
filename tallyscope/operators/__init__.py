"""Panel operators, grouped by subject."""
