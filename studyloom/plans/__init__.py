"""Whole plans over a table of documents."""
