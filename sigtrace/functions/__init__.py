"""Column builders: scalar functions that stay in generated code."""
