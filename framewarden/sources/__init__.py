"""Readers of tool output and writers of results."""
