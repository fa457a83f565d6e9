"""Expressions that the operators share."""
