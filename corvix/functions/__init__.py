"""Column expressions and the SQL functions made of them."""
