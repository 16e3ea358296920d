"""Column expressions: extraction, grading, prompt rendering, vector arithmetic."""
