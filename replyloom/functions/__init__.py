"""Column expressions: text, masking, ordered rules, reply rubric."""
