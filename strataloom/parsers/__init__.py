"""Parsers that turn one file into rows."""
