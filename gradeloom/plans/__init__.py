"""Composed evaluations and the task specifications that select them."""
