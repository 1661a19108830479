"""Column expressions and the small numeric helpers used inside tasks."""
