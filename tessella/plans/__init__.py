"""Registered queries: how the operators are bound to tables, and their SQL twins."""
