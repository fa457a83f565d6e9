"""Composed jobs over the example tables, with their SQL counterparts."""
