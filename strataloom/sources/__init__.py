"""Readers and writers of repository data."""
