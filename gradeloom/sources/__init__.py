"""Readers and writers for the tables the library works on."""
