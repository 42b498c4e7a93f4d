"""Column expressions and ordered-scan helpers shared by the operators."""
