"""Column expressions. Each takes and returns a Column; none needs Python workers."""
