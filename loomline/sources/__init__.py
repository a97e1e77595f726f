"""Readers of lines and labels, writers of results."""
