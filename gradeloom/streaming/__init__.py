"""Stateless grading of generations that arrive as a stream."""
