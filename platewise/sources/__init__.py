"""Readers and writers: spreadsheet exports, parsed runs, result tables."""
