"""Column expressions that several operators use."""
