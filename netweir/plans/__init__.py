"""Registered queries: operators applied to the given tables, with SQL for the expected rows."""
