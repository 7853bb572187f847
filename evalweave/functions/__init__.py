"""Column expressions: hashing, ranks, text, maths, boxes."""
