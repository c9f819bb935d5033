"""Additions beyond the batch operators: streaming assignment and probe counts."""
