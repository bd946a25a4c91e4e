"""Registered queries over the test tables, and their SQL."""
