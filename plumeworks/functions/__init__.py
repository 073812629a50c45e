"""Column expressions: no UDFs, all within generated code."""
