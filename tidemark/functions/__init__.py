"""Column expressions and small join and staging helpers."""
