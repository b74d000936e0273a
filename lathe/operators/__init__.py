"""Relational operators: corpora of programs and texts, grading, timing."""
