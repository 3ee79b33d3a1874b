"""Column expressions: Column in, Column out, all of them inside code generation."""
